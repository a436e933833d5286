"""Judges: rubric scores over HTTP, and extraction of a structured answer that is then scored as any other.

A judge is a template and an endpoint. Requests are rendered as Columns; calls go through mapInArrow in batches of a fixed
size, and an answer belongs to its sample by id only. An answer that breaks the contract is a row with an error."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.examples import reference_text
from ..functions.templates import render
from ..functions.text import run_steps
from ..plans.planner import plan_offline
from .enrich import matched, post, predict
from .metrics import score_sample

#: templates by id; sample_id, task_id, reference_text and candidate_text are filled in
TEMPLATES: dict[str, str] = {
    "bioacoustic_classification_v1": "Grade a classification of a recording.\nTask {{ task_id }}, sample {{ sample_id }}.\nTrue label: {{ reference_text }}\nAnswer: {{ candidate_text }}\nGive a number from 0 (wrong) to 1 (right).",
    "bioacoustic_counting_v1": "Grade a count of what a recording holds.\nTask {{ task_id }}, sample {{ sample_id }}.\nTrue count: {{ reference_text }}\nAnswer: {{ candidate_text }}\nGive 1 for the same number, less the further it is off, 0 at least.",
    "bioacoustic_open_qa_v1": "Grade an answer to an open question about a recording.\nTask {{ task_id }}, sample {{ sample_id }}.\nReference: {{ reference_text }}\nAnswer: {{ candidate_text }}\nGive a number from 0 (nothing right) to 1 (all right) and a reason.",
    "extraction_classification_v1": "Labels:\n{{ reference_text }}\n\nText:\n{{ candidate_text }}\n\nWhich one of the labels does the text mean?",
    "extraction_detection_v1": "Labels:\n{{ reference_text }}\n\nText:\n{{ candidate_text }}\n\nWhich of the labels does the text name? Part them by commas.",
    "extraction_captioning_v1": "Text:\n{{ candidate_text }}\n\nThe description alone:",
}
#: what the system message of an extraction says
SYSTEM = {
    "extraction_classification_v1": "You turn free text into data. Reply with one label of the list, exactly as it is written there, and nothing else.",
    "extraction_detection_v1": "You turn free text into data. Reply with the labels of the list that the text names, parted by commas, and nothing else.",
    "extraction_captioning_v1": "You turn free text into data. Reply with one short sentence that describes the recording, and nothing else.",
}


def register_template(name: str, source: str) -> None:
    if not name.strip():
        raise ValueError("a template needs a name")
    if name in TEMPLATES:
        raise ValueError(f"there is a template {name!r} already")
    TEMPLATES[name] = source


def template(name: str) -> str:
    if name not in TEMPLATES:
        raise LookupError(f"no template {name!r}; there are {list_templates()}")
    return TEMPLATES[name]


def list_templates() -> list[str]:
    return sorted(TEMPLATES)


def extraction_template(task_type: str | None) -> str:
    task = (task_type or "").lower()
    return f"extraction_{'captioning' if 'caption' in task else 'detection' if 'detection' in task else 'classification'}_v1"


def _fields(labels: Column, candidate: Column) -> dict[str, Column]:
    return {"sample_id": F.col("sample_id"), "task_id": F.col("task_id"), "reference_text": reference_text(labels), "candidate_text": F.coalesce(candidate, F.lit(""))}


def rubric_requests(df: DataFrame, name: str = "bioacoustic_open_qa_v1", labels: str = "labels", candidate: str = "prediction") -> DataFrame:
    """JUDGE_REQUEST rows of examples (sample_id, task_id, labels as JSON) with an answer each."""
    names = _fields(F.col(labels), F.col(candidate))
    return df.select("sample_id", render(template(name), names).alias("rubric"), names["reference_text"].alias("reference_text"), names["candidate_text"].alias("candidate_text"))


def rubric_judge(requests: DataFrame, call: Callable[[list[dict]], list[dict]], size: int = 8) -> DataFrame:
    """JUDGE_SCORE rows of JUDGE_REQUEST rows; call takes and gives items of the judge's contract. A score is a number from
    0 to 1; any other is an error of its row."""

    def run(batches):
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for i in range(0, len(rows), size):
                part = rows[i : i + size]
                try:
                    found = matched([r["sample_id"] for r in part], call(part))
                except Exception as error:  # stays with its samples
                    out += [(r["sample_id"], None, None, f"{type(error).__name__}: {error}") for r in part]
                    continue
                for a in found:
                    score, error = a.get("score"), a.get("error")
                    if not error and (isinstance(score, bool) or not isinstance(score, int | float) or not 0 <= score <= 1):
                        score, error = None, f"score is no number from 0 to 1: {score!r}"
                    out.append((a["sample_id"], None if error else float(score), a.get("rationale"), error))
            if out:
                kinds = (pa.string(), pa.float64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["sample_id", "score", "rationale", "error"])

    picked = requests.select(F.col("sample_id").cast("string").alias("sample_id"), "rubric", "reference_text", "candidate_text")
    return picked.mapInArrow(run, "sample_id string, score double, rationale string, error string")


def http_judge(url: str) -> Callable[[list[dict]], list[dict]]:
    return lambda part: post(url, {"schema_version": "judge_scores_v1", "items": part})["items"]


def extraction_requests(df: DataFrame, task_type: str | None, labels: str = "labels", candidate: str = "prediction", name: str | None = None, system: str | None = None, max_tokens: int = 128) -> DataFrame:
    """(sample_id, request as JSON): a system message that says what to do, a user message from the template."""
    name = name or extraction_template(task_type)
    user = render(template(name), _fields(F.col(labels), F.col(candidate)))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.array(turn("system", F.lit(system if system is not None else SYSTEM.get(name, ""))), turn("user", user)).alias("messages"), F.struct(F.lit(max_tokens).alias("max_tokens"), F.lit(0.0).alias("temperature")).alias("generation_config"))
    return df.select("sample_id", F.to_json(body).alias("request"))


def extract(df: DataFrame, call: Callable[[list[dict]], list[dict]], task_type: str | None, size: int = 8, **options) -> DataFrame:
    """(sample_id, extracted, error): what the judge makes of each answer, stripped; empty where it fails."""
    found = predict(extraction_requests(df, task_type, **options), call, size)
    text = F.regexp_replace(F.coalesce("prediction", F.lit("")), r"(?U)^\s+|\s+$", "")
    return found.select("sample_id", F.when(F.col("error").isNull(), text).otherwise("").alias("extracted"), "error")


def extractor_rescore(df: DataFrame, call: Callable[[list[dict]], list[dict]], task_type: str | None, vocab: list[str], size: int = 8) -> DataFrame:
    """df (sample_id, task_id, labels as JSON, prediction) with extracted, processed and scores: the extracted text goes
    through the steps of a rescoring and is scored against the labels."""
    found = extract(df, call, task_type, size)
    made = df.join(found.withColumnRenamed("error", "judge_error"), "sample_id", "left")
    raw = F.coalesce("extracted", F.lit(""))
    made = made.withColumn("processed", run_steps(raw, *plan_offline(vocab, task_type))["text"])
    target = reference_text(F.col("labels"))
    kind = F.when(F.col("labels").isNull(), "none").otherwise("text")
    return made.withColumn("scores", score_sample(F.col("processed"), raw, kind, target, F.split(target, ","), F.lit(task_type)))


def judge_outputs(scores: DataFrame) -> DataFrame:
    """One JSON line for each judged sample, keys sorted."""
    from ..sources.sinks import canonical_json

    return scores.select(canonical_json(**{c: F.col(c) for c in ("sample_id", "score", "rationale", "error")}).alias("value"))


def echo_judge(part: list[dict]) -> list[dict]:
    """A deterministic judge for tests without an endpoint: the share of the reference's words that the answer has."""
    out = []
    for r in part:
        words = set(r["reference_text"].lower().split())
        share = len(words & set(r["candidate_text"].lower().split())) / len(words) if words else 0.0
        out.append({"sample_id": r["sample_id"], "score": share, "rationale": f"{len(words)} words"})
    return out


def stub_extractor(part: list[dict]) -> list[dict]:
    """A deterministic extractor: the text that the user message quotes."""
    out = []
    for r in part:
        text = r["messages"][-1]["content"].split("Text:\n", 1)[-1].split("\n\n")[0]
        out.append({"sample_id": r["sample_id"], "predictions": [f" {text} "]})
    return out


__all__ = ["TEMPLATES", "echo_judge", "extract", "extractor_rescore", "http_judge", "judge_outputs", "list_templates", "register_template", "rubric_judge", "rubric_requests", "stub_extractor", "template"]
