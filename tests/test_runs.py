import base64
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import rows
from tallyspark.operators import enrich, rescore, runs
from tallyspark.plans.config import ModelRef, RunConfig, Task
from tallyspark.schemas import PREDICTION, normalize_labels
from tallyspark.sources import readers, sinks
from tallyspark.streaming.rescore import stream_rescore


def test_ordinal_is_dense_and_before_the_filter(spark, tmp_path):
    spark.range(500).repartition(7).withColumn("split", F.when(F.col("id") % 2 == 0, "a").otherwise("b")).write.parquet(str(tmp_path / "x"))
    got = readers.read(spark, "parquet", str(tmp_path / "x"), order=["id"], split="b").collect()
    assert all(r.ordinal == r.id for r in got) and len(got) == 250
    with pytest.raises(KeyError):
        readers.read(spark, "nope", "x")


def test_ids_labels_and_paths(spark):
    one = spark.range(1)
    got = one.select(rows.resolve_id([F.lit("  u1  ")], F.lit("x")).alias("a"), rows.resolve_id([F.lit(" ")], rows.synthetic_id("h:", F.lit("a"), F.lit(None))).alias("b"), rows.tier_number(F.lit("tier_3_hard")).alias("t"), rows.keep_last_placeholder(F.lit(f"x{rows.PLACEHOLDER}y{rows.PLACEHOLDER}z")).alias("p")).first()
    assert got.a == "u1" and got.b.startswith("h:") and len(got.b) == 66 and got.t == 3 and got.p == f"x[audio]y{rows.PLACEHOLDER}z"
    kinds = spark.createDataFrame([('"a"',), ('["a","b"]',), ('{"x":1}',), (None,), ("{bad",), ("3",)], "j string").select(normalize_labels(F.col("j")).alias("l")).collect()
    assert [(r.l.kind, r.l.text, r.l.list) for r in kinds] == [("text", "a", None), ("list", None, ["a", "b"]), ("object", None, None), ("none", None, None), ("text", "{bad", None), ("text", "3", None)]
    tail = one.select(rows.choose_paths(F.array(*(F.lit(x) for x in "abcd")), F.lit("q"), F.array().cast("array<string>"), F.lit(4)).alias("p")).first().p
    assert tail == ["a", "b", "c", "q"]
    coerced = spark.createDataFrame([('["a","b"]',), ('["a",""]',), ("[1,",), (None,)], "s string").select(rows.string_list(F.col("s")).alias("x")).collect()
    assert [r.x for r in coerced] == [["a", "b"], None, None, None]


def test_artifacts_with_malformed_lines(spark, tmp_path):
    leaf = tmp_path / "m" / "suite" / "task1"
    leaf.mkdir(parents=True)
    (leaf / "predictions.jsonl").write_text('{"sample_id":"1","predictions":["a"]}\n\nnot json\n')
    got = readers.read(spark, "run_files", str(tmp_path), schema=PREDICTION).select("path", "malformed", "row.sample_id", rows.model_of_path(F.col("path")).alias("m"), rows.task_of_path(F.col("path")).alias("t")).collect()
    assert {(r.malformed, r.sample_id, r.m, r.t) for r in got} == {(False, "1", "m", "task1"), (True, None, "m", "task1")}
    good, bad = readers.quarantine(readers.read(spark, "jsonl", str(leaf / "predictions.jsonl"), schema=PREDICTION, keep_malformed=True))
    assert good.count() == 1 and bad.count() == 1


def test_taxonomy_and_audio(spark, tmp_path):
    (tmp_path / "t.csv").write_text("SPECIES_CODE,SCI_NAME\n a1 , Turdus merula \nb2,\nc3,Jynx torquilla\n")
    overlay = spark.createDataFrame([("old", "Pica pica"), ("a1", "wrong")], "code string, name string")
    tax = readers.read(spark, "taxonomy", str(tmp_path / "t.csv"), overlay=overlay)
    codes = spark.createDataFrame([(1, ["old", "a1", "old", "zz"])], "i int, codes array<string>")
    assert readers.codes_to_names(codes, "i", "codes", tax, {"Pica pica": "Pica"}).first().names == ["Pica", "Turdus merula"]
    have, missing = readers.audio_for(spark.createDataFrame([("x",), ("y",)], "audio_id string"), spark.createDataFrame([("x", 1)], "audio_id string, b int"))
    assert have.count() == 1 and [r.audio_id for r in missing.collect()] == ["y"]


@pytest.mark.parametrize("chunked", ["true", "false"])
def test_embedded_files_are_one_line_of_base64(spark, chunked):
    files = {f"f{n}": bytes(i * 7 % 256 for i in range(n)) for n in (0, 56, 57, 58, 59, 115, 20_000)}
    requests = spark.createDataFrame([(p, p, None) for p in [*files, "gone"]], "id string, path string, sample_rate int")
    spark.conf.set("spark.sql.chunkBase64String.enabled", chunked)
    try:
        got = enrich.embedded(requests, spark.createDataFrame(list(files.items()), "path string, content binary"), "id", "path").collect()
    finally:
        spark.conf.unset("spark.sql.chunkBase64String.enabled")
    want = {p: ("base64_wav", base64.b64encode(raw).decode()) for p, raw in files.items()} | {"gone": ("file_path", "gone")}
    assert {r.id: (r.payload_type, r.data) for r in got} == want and len(got) == len(want)


def test_registry_and_config(tmp_path):
    (tmp_path / "task").mkdir()
    (tmp_path / "task" / "a.yaml").write_text("t1:\n  task_type: qa\nt2:\n  task_type: detection\n")
    (tmp_path / "task" / "b.yaml").write_text("id: t3\ntask_type: qa\n")
    assert sorted(readers.registry(str(tmp_path))["task"]) == ["t1", "t2", "t3"]
    config = RunConfig([ModelRef(id="m")], suite="s")
    assert [t for _, t in config.plan({"s": ["a.yaml", "b"]})] == ["a", "b"]
    for bad in (lambda: ModelRef(), lambda: ModelRef("a", {}), lambda: RunConfig([ModelRef("a")]), lambda: RunConfig([ModelRef("a")], "s", ["t"]), lambda: RunConfig([ModelRef("a")], "s", limit=0), lambda: Task("t", "qa", []), lambda: Task("t", "qa", ["f1"], judge=3)):
        with pytest.raises(ValueError):
            bad()


def test_joins_and_selection(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "sample_id string")
    b = spark.createDataFrame([("1", 1), ("3", 2)], "sample_id string, v int")
    assert {tuple(r) for r in runs.checked_pairs(a, b)[1].collect()} == {("2", "missing"), ("3", "unexpected")}
    assert not runs.alignment(a, b, "sample_id").first().one_to_one
    x = spark.createDataFrame([("t", "a", 5, 9, 1), ("t", "b", 9, 9, 0), ("u", "c", 3, 9, 0), ("u", "d", 3, 9, 7)], "t string, path string, n int, want int, mtime int")
    assert {r.t: (r.path, r.full) for r in runs.winners(x, ["t"], "want", "n", "mtime", "path").collect()} == {"t": ("b", True), "u": ("d", False)}
    assert runs.batch_size(None, None) == 8 and runs.batch_size(16, 4) == 4 and runs.batch_size(16, 4, supported=False) == 1
    table = runs.results_table(spark.createDataFrame([("m|x", "a", 0.5)], "m string, t string, v double"), "m", "t", "v", ["a", "b"])
    assert sinks.markdown(table, "m", ["a", "b", "covered"]).splitlines()[-1] == "| m\\|x | 0.5000 | - | 1/2 |"


def test_work_folders_can_be_cleared(spark):
    path = sinks.work_dir(spark)
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    sinks.clear_work(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_checkpoint_merges(tmp_path):
    path = str(tmp_path / "c.json")
    sinks.write_checkpoint(path, "r", ["b"], 1, 3, [])
    got = sinks.write_checkpoint(path, "r", ["a", "b"], 1, 1, [{"sample_id": "a"}])
    assert got["completed_sample_ids"] == ["a", "b"] and got["n_errors"] == 3 and json.load(open(path)) == got


def test_retries_and_matching():
    calls, waits = [], []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return b'{"ok": 1}'

    def open_(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return Answer()

    assert enrich.post("http://x", {}, open_=open_, sleep=waits.append) == {"ok": 1} and len(waits) == 2 and waits[1] > waits[0]

    def refused(request, timeout):
        raise urllib.error.HTTPError("u", 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        enrich.post("http://x", {}, open_=refused, sleep=waits.append)
    with pytest.raises(ValueError):
        enrich.matched(["a"], [{"sample_id": "b"}])


def test_a_failing_batch_stays_with_its_samples(spark):
    def call(part):
        if any(p["sample_id"] == "3" for p in part):
            raise RuntimeError("down")
        return [{"sample_id": p["sample_id"], "predictions": ["x"]} for p in part]

    df = spark.createDataFrame([(str(i), "{}") for i in range(6)], "sample_id string, request string").coalesce(1)
    got = {r.sample_id: r for r in enrich.predict(df, call, size=2).collect()}
    assert sorted(k for k, r in got.items() if r.error) == ["2", "3"] and got["0"].prediction == "x"
    assert "{{" not in spark.range(1).select(enrich.judge_request("equivalence", F.lit("a"), F.lit("b"))).first()[0]


def test_rescore_stream_equals_batch_and_adds_nothing_twice(spark, tmp_path):
    preds = spark.createDataFrame([("1", 0, "Yes, it is", None), ("2", 1, "no", None), ("3", 2, "x", "down")], "sample_id string, ordinal int, prediction string, error string")
    targets = spark.createDataFrame([("1", 0, "No"), ("1", 1, "Yes"), ("2", 2, "Yes"), ("3", 3, "No")], "sample_id string, ordinal int, target string")
    vocab = rescore.collect_vocabulary(targets)
    assert vocab == ["No", "Yes"]
    whole = rescore.rescore(preds, targets, vocab, "classification")
    got = {r.sample_id: (r.processed, (r.scores or {}).get("accuracy")) for r in whole.collect()}
    assert got == {"1": ("Yes", 1.0), "2": ("No", 0.0), "3": ("No", None)} or got["3"][1] is None
    s = {r.metric: (r["mean"], r.n_samples, r.n_errors) for r in rescore.summary(whole).collect()}
    assert s["accuracy"] == (0.5, 3, 1)
    preds.write.parquet(str(tmp_path / "in"))
    for check in "ab":
        source = spark.readStream.schema(preds.schema).parquet(str(tmp_path / "in"))
        stream_rescore(source, lambda df: rescore.rescore(df, targets, vocab, "classification"), str(tmp_path / "out"), str(tmp_path / check)).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
