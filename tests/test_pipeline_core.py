import json

import numpy as np
import pytest

from tallyspark.__main__ import main
from tallyspark.functions import audio
from tallyspark.operators import pipeline
from tallyspark.plans.config import Task
from tallyspark.sources import sinks

LEAF = '{"sample_id":"%s","predictions":["%s"]}\n'


def test_run_resumes_and_keeps_failures(spark, tmp_path):
    rows = [(str(i), i, "is it?", "Yes" if i % 2 else "No") for i in range(9)] + [("bad", 9, "x <Audio><AudioHere></Audio>", "No")]
    examples = spark.createDataFrame(rows, "sample_id string, ordinal int, text string, target string")

    def call(part):
        return [{"sample_id": p["sample_id"], "predictions": ["Yes, it is"]} for p in reversed(part)]

    task = Task("t", "classification", ["accuracy"], ["Yes", "No"])
    first = pipeline.run_task(examples.where("ordinal < 4"), task, call, str(tmp_path / "s"))
    assert first.count() == 4
    whole = pipeline.run_task(examples, task, call, str(tmp_path / "s"))
    got = pipeline.summarize(whole, task)
    assert (got["n_samples"], got["n_errors"]) == (10, 1)
    assert got["mean"]["accuracy"] == pytest.approx(4 / 9) and 0 < got["mean"]["macro_f1"] < 1
    assert pipeline.pairs(examples, whole, "m", "r").count() == 10


def test_consolidate_and_validate(spark, tmp_path):
    for model, n in (("m1", 3), ("m2", 2)):
        for run, k in (("a", n), ("b", 1)):
            leaf = tmp_path / model / "suite" / run / "task1"
            leaf.mkdir(parents=True)
            (leaf / "predictions.jsonl").write_text("".join(LEAF % (i, "x") for i in range(k)) + ("oops\n" if run == "b" else ""))
            if run == "a":
                (leaf / "summary.json").write_text("{}")
    expected = spark.createDataFrame([("task1", 3)], "task string, expected int")
    inventory, rows = pipeline.consolidate(spark, str(tmp_path), expected)
    assert {(r.model, r.n, r.malformed) for r in inventory.where("winner").collect()} == {("m1", 3, 0), ("m2", 2, 0)}
    assert rows.count() == 5
    problems = {(r.folder, r.problem) for r in pipeline.validate(spark, str(tmp_path), ["summary.json"]).collect()}
    assert problems == {(f"{m}/suite/b/task1", p) for m in ("m1", "m2") for p in ("malformed line", "missing summary.json")}
    done = pipeline.upload(spark, str(tmp_path / "m1/suite/a/task1"), f"file://{tmp_path}/up", ["summary.json", "none.json"])
    assert done == ["summary.json"] and (tmp_path / "up" / "summary.json").exists()


def test_audio_round_trip(spark):
    tone = np.sin(np.arange(1600) / 10).astype(np.float32) * 0.5
    raw = audio.wav_of(tone, 16000)
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"no")), ("c", None)], "id string, content binary")
    got = {r.id: r for r in audio.decode(df, "id", "content", rate=16000).collect()}
    assert np.allclose(got["a"].samples, tone, atol=1e-3) and got["b"].error and got["c"].error
    assert len(audio.decode(df, "id", "content", rate=8000, most_seconds=0.05).where("id = 'a'").first().samples) == 400
    files = audio.wav_files(audio.decode(df, "id", "content", rate=16000).where("error IS NULL"), "id", "samples", "sample_rate").first()
    assert files.file_name.endswith(".wav") and len(files.file_name) == 68


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "reg" / "task").mkdir(parents=True)
    (tmp_path / "reg" / "task" / "a.yaml").write_text("t1:\n  task_type: qa\n")
    assert main(["list", str(tmp_path / "reg"), "task"]) == 0 and capsys.readouterr().out.strip() == "t1"
    main(["describe", str(tmp_path / "reg"), "task", "t1"])
    assert json.loads(capsys.readouterr().out) == {"task_type": "qa"}
    assert sinks.sync_labels(str(tmp_path / "reg" / "task" / "a.yaml"), "t1", ["x"]) and not sinks.sync_labels(str(tmp_path / "reg" / "task" / "a.yaml"), "t1", ["x"])
    spark.createDataFrame([("1", 0, "yes", None)], "sample_id string, ordinal int, prediction string, error string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("1", 0, "Yes")], "sample_id string, ordinal int, target string").write.parquet(str(tmp_path / "y"))
    main(["score-from-file", str(tmp_path / "p"), str(tmp_path / "o"), "--targets", str(tmp_path / "y"), "--labels", "Yes", "No"])
    assert json.load(open(tmp_path / "o" / "summary.json"))["mean"]["accuracy"] == 1.0
