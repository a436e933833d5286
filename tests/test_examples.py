import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import examples, rows, templates
from tallyspark.operators import artifacts, enrich, judges, metrics, pipeline, runs
from tallyspark.plans.config import Task
from tallyspark.sources import readers, sinks


def test_templates(spark):
    df = spark.createDataFrame([(["a", "b"], "x", None), ([], " y ", "z")], "items array<string>, s string, n string")
    names = {c: F.col(c) for c in df.columns}
    source = "{% for i in items %}[{{ i }}{% if i == 'a' %}!{% endif %}]{% endfor %}{% if not items %}none{% endif %} {{ s | trim | upper }}{{ n | default('-') }} {{ items | join('; ') }}"
    assert [r[0] for r in df.select(templates.render(source, names, {"items"})).collect()] == ["[a!][b] X- a; b", "none Yz "]
    for bad in ("{{ nobody }}", "{{ s | nofilter }}", "{% for i in items %}", "{% while x %}", "{% if s %}x"):
        with pytest.raises(templates.TemplateError):
            templates.render(bad, names)


def test_audio_of_other_kinds_and_missing_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "audio array<double>")
    assert [r[0] and tuple(r[0]) for r in df.select(examples.audio_summary(df)).collect()] == [(None, None, 2), None]
    bare = spark.createDataFrame([("u1",)], "id string")
    assert bare.select(examples.audio_summary(bare)).first()[0] is None
    assert bare.select(examples.audio_paths(bare)).first()[0] == []
    e = examples.single_examples(bare, F.col("id"), "test").first()
    assert (e.labels, e.metadata) == (None, {})
    listed = spark.createDataFrame([([],), (["b"],), (None,)], "output array<string>")
    assert [r.output for r in examples.with_aliases(listed, labels=F.array(F.lit("a"))).collect()] == [["a"], ["b"], ["a"]]


def test_messages_that_are_none(spark):
    df = spark.createDataFrame([(None,), ("{}",), ("[]",), ('[{"role":"u","content":"c","more":1}]',)], "j string")
    got = [(r.m.messages, r.m.error) for r in df.select(examples.coerced_messages(F.col("j")).alias("m")).collect()]
    assert got[0][1] == got[1][1] == "no list of messages" and got[2] == ([], None)
    assert [tuple(m) for m in got[3][0]] == [("u", "c")]


def test_front_door_and_backend(spark, tmp_path):
    messages = [("user", f"hear {rows.PLACEHOLDER} and {rows.PLACEHOLDER}"), ("assistant", " yes ")]
    data = [("1", "few", ["c1"], "q", messages), ("2", "few", ["c1", "c2", "c3"], None, messages), (" ", "few", ["a", "b"], None, messages), ("4", "other", ["a"], "b", messages)]
    spark.createDataFrame(data, "id string, task string, context_source_paths array<string>, query_source_path string, messages array<struct<role:string,content:string>>").write.parquet(str(tmp_path / "t"))
    good, bad = readers.front_door(spark, {"few": 4, "one": 1}, str(tmp_path / "t"), "few", root="/r")
    got = {r.sample_id: (r.labels, json.loads(r.metadata["audio_paths"])) for r in good.collect()}
    assert got.pop("1") == ("yes", ["/r/c1", "/r/q"]) and list(got.values()) == [("yes", ["/r/a", "/r/b"])]
    assert [r.sample_id for r in bad.collect()] == ["2"]
    with pytest.raises(KeyError):
        readers.front_door(spark, {"few": 4}, str(tmp_path / "t"), "fewer")
    assert readers.backend("parquet", {"backend": "jsonl"}, {}) == "parquet"
    assert readers.backend(" ", {"backend": "jsonl"}, {"TALLYSPARK_BACKEND": "parquet"}) == "jsonl"
    assert readers.backend(None, {}, {"TALLYSPARK_BACKEND": "hf"}) == "huggingface" and readers.backend(env={}) == "parquet"
    with pytest.raises(KeyError):
        readers.backend("nothing", env={})


def test_appended_rows_without_a_key_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(None, 1), (None, 2), ("null", 3), ("a", 4), ("a", 4)], "sample_id string, n int")
    sinks.append_new(df, path)
    sinks.append_new(df, path)
    assert sorted((r.n for r in spark.read.parquet(path).collect())) == [1, 2, 3, 4]


def test_running_sums_by_key_against_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 7 == 0).cast("long").alias("v")).repartition(7)
    got = rows.with_running_by(df, "k", [F.col("id")], {"s": F.col("v"), "n": F.lit(1).cast("long")})
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "id", "v", F.sum("v").over(w).alias("s"), F.count("*").over(w).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_asked_columns_are_numbered(spark, sf_dir):
    got = readers.read(spark, "parquet", f"{sf_dir}/documents.parquet", columns=["doc_id"], order=["doc_id"], where=F.col("lang") == "de")
    assert "text" not in got._jdf.queryExecution().toString()


class Answer:
    def __init__(self, body, status=200):
        self.body, self.status = body, status

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.body


def test_preflight():
    def server(info, status=200):
        return lambda url, timeout: Answer(b"ok", status) if url.endswith("/health") else Answer(info)

    good = b'{"schema_versions": ["predictions_v1"], "model": "m"}'
    assert enrich.preflight("http://h/predict", open_=server(good))["model"] == "m"
    for open_ in (server(good, 503), server(b"[]"), server(b'{"schema_versions": ["v0"]}'), server(b"{}")):
        with pytest.raises(RuntimeError):
            enrich.preflight("http://h/predict", open_=open_)


def test_judges(spark):
    with pytest.raises(ValueError):
        judges.register_template(" ", "x")
    with pytest.raises(ValueError):
        judges.register_template("bioacoustic_open_qa_v1", "x")
    with pytest.raises(LookupError):
        judges.template("nothing")
    assert len(judges.list_templates()) >= 6
    assert [judges.extraction_template(x) for x in (None, "Detection", "captioning")] == [f"extraction_{k}_v1" for k in ("classification", "detection", "captioning")]
    df = spark.createDataFrame([("1", "t", "a b", "a"), ("2", None, None, None)], "sample_id string, task_id string, labels string, prediction string")
    got = {r.sample_id: r for r in judges.rubric_judge(judges.rubric_requests(df), judges.echo_judge).collect()}
    assert got["1"].score == 0.5 and got["2"].score == 0.0

    def wrong(part):
        return [{"sample_id": "x", "score": 1}]

    assert all(r.score is None and "ValueError" in r.error for r in judges.rubric_judge(judges.rubric_requests(df), wrong).collect())
    for score in (True, "1", -0.1, None):
        call = lambda part, s=score: [{"sample_id": r["sample_id"], "score": s} for r in part]
        assert all(r.error for r in judges.rubric_judge(judges.rubric_requests(df), call).collect())
    failed = judges.extract(df, wrong, "detection").collect()
    assert [(r.extracted, bool(r.error)) for r in failed] == [("", True)] * 2
    lines = [json.loads(r.value) for r in judges.judge_outputs(judges.rubric_judge(judges.rubric_requests(df), judges.echo_judge)).collect()]
    assert [list(x) for x in lines] == [["error", "rationale", "sample_id", "score"]] * 2


def test_run_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i, "hi", "Yes") for i in range(6)], "sample_id string, ordinal int, text string, target string")
    call = lambda part: [{"sample_id": p["sample_id"], "predictions": ["yes"], "server_info": {"model": "m"}} for p in part]
    task = Task("t", "classification", ["accuracy"], ["Yes", "No"])
    scored = pipeline.run_task(df, task, call, str(tmp_path / "s"), size=2)
    judged = spark.createDataFrame([("1", 1.0, None, None)], "sample_id string, score double, rationale string, error string")
    artifacts.write_run(str(tmp_path), pipeline.summarize(scored, task), scored, judged=judged)
    summary = json.loads((tmp_path / "summary.json").read_text())
    assert summary["latency"]["n_batches"] >= 3 and summary["model_identity"] == {"model": "m"} == json.loads((tmp_path / "model_identity.json").read_text())
    assert spark.read.text(str(tmp_path / "judge_outputs")).count() == 1
    assert artifacts.throughput(10, 2_000_000, 2.0) == {"rows": 10, "seconds": 2.0, "rows_per_sec": 5.0, "mb_per_sec": 1.0}
    assert artifacts.throughput(1, 1, 0)["rows_per_sec"] == 0.0
    assert artifacts.run_summary([{"a": 1}], "r")["items"] == [{"a": 1}]
    with pytest.raises(ValueError):
        records = pipeline.pairs(df, scored, "m", "r")
        pipeline.write_pairs(records, str(tmp_path / "p"), "r")
        pipeline.write_pairs(records, str(tmp_path / "p"), "r")
    assert json.loads((tmp_path / "p" / "manifest.json").read_text())["subsets"]["all"]["n"] == 6
    assert pipeline.select_examples(df, 2).count() == 2 and pipeline.select_examples(df, 3, "sample", 1).count() == 3
    with pytest.raises(ValueError):
        pipeline.select_examples(df, 1, "worst")


def test_corpus_metrics_that_lack_a_part(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "d e", "d f")], "k int, p string, y string")
    with pytest.warns(UserWarning, match="SPICE"):
        half = metrics.spider(df, "k", "p", "y").first()
    whole = metrics.spider(df, "k", "p", "y", spark.createDataFrame([(0.5,)], "spice double")).first()
    assert not half.has_spice and whole.has_spice and whole.spider == pytest.approx(half.spider + 0.25)
    with pytest.warns(UserWarning, match="no corpus metric"):
        assert metrics.dataset_metric(df, "classification", "nothing", "y", "k") is None


def test_cache_keeps_the_last_value(spark, tmp_path):
    path = str(tmp_path / "c")
    runs.store(spark.createDataFrame([("a", "1", None), ("b", "2", "failed")], "key string, value string, error string"), path)
    runs.store(spark.createDataFrame([("a", "3")], "key string, value string"), path)
    hits, misses = runs.cached(spark.createDataFrame([("a",), ("b",)], "key string"), spark.read.parquet(path))
    assert [tuple(r) for r in hits.collect()] == [("a", "3")] and [r.key for r in misses.collect()] == ["b"]


def test_work_folder_on_a_cluster_is_never_local():
    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = self, self
            self.master, self.applicationId = master, "app-1"

        def get(self, key, default=None):
            return default

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            sinks.work_dir(Session(master))
    first, second = sinks.work_dir(Session("local[4]")), sinks.work_dir(Session("local[4]"))
    assert first != second and first.split("/tallyspark/")[0] == second.split("/tallyspark/")[0]
