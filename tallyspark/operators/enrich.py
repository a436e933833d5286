"""Calls of models and judges as an enrichment of partitions: batched, retried, matched by id only."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_yes_no

RETRY_STATUS = {408, 429, *range(500, 600)}


def post(url: str, body: dict, attempts: int = 12, first: float = 0.5, longest: float = 30.0, jitter: float = 0.25, timeout: float = 600, open_=urllib.request.urlopen, sleep=time.sleep) -> dict:
    """POST JSON with exponential backoff on lost connections and on the statuses worth a retry."""
    wait = first
    for attempt in range(attempts):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with open_(request, timeout=timeout) as response:
                return json.loads(response.read())
        except urllib.error.HTTPError as error:
            if error.code not in RETRY_STATUS or attempt == attempts - 1:
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if attempt == attempts - 1:
                raise
        sleep(wait * (1 + random.uniform(-jitter, jitter)))
        wait = min(longest, 2 * wait)
    raise AssertionError("unreachable")


def matched(ids: list[str], answers: list[dict]) -> list[dict]:
    """Answers in the order of the ids; both must be the same set without repeats."""
    by_id = {a["sample_id"]: a for a in answers}
    if len(by_id) != len(answers) or set(by_id) != set(ids) or len(set(ids)) != len(ids):
        raise ValueError(f"answers don't match requests: {len(answers)} for {len(ids)}")
    return [by_id[i] for i in ids]


_ANSWER = {"sample_id": pa.string(), "prediction": pa.string(), "error": pa.string(), "predictions": pa.list_(pa.string()), "finish_reason": pa.string(), "prompt_tokens": pa.int32(), "completion_tokens": pa.int32(), "latency_sec": pa.float64(), "server_info": pa.string(), "batch": pa.string(), "roundtrip_sec": pa.float64()}
ANSWER = "sample_id string, prediction string, error string, predictions array<string>, finish_reason string, prompt_tokens int, completion_tokens int, latency_sec double, server_info string, batch string, roundtrip_sec double"


def mapped(answer: dict, server_info: dict | None, batch: str, seconds: float) -> tuple:
    """One answer as a row of ANSWER; its predictions, usage and times as the server gave them."""
    usage = answer.get("usage") or {}
    texts = [str(x) for x in answer.get("predictions") or []]
    info = answer.get("server_info") or server_info
    return (
        answer["sample_id"], texts[0] if texts else None, answer.get("error"), texts, answer.get("finish_reason"), usage.get("prompt_tokens"), usage.get("completion_tokens"),
        answer.get("latency_sec"), json.dumps(info, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if info else None, batch, seconds,
    )


def predict(requests: DataFrame, call: Callable[[list[dict]], list[dict]], size: int = 8, server_info: dict | None = None) -> DataFrame:
    """ANSWER rows of requests (sample_id, request as JSON text); call gets at most size at once, and a call that fails
    gives its own rows an error and no others. batch names a call, roundtrip_sec is what it took."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), size):
                part, name, began = rows[i : i + size], uuid.uuid4().hex, time.perf_counter()
                try:
                    found = matched([r["sample_id"] for r in part], call([{"sample_id": r["sample_id"], **json.loads(r["request"])} for r in part]))
                    seconds = time.perf_counter() - began
                    out = [mapped(a, server_info, name, seconds) for a in found]
                except Exception as error:  # stays with its samples
                    seconds = time.perf_counter() - began
                    out = [mapped({"sample_id": r["sample_id"], "error": f"{type(error).__name__}: {error}"}, server_info, name, seconds) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ANSWER.values(), strict=True)], names=list(_ANSWER))

    return requests.select(F.col("sample_id").cast("string").alias("sample_id"), "request").mapInArrow(run, ANSWER)


def preflight(url: str, schema: str = "predictions_v1", timeout: float = 30, open_=urllib.request.urlopen) -> dict:
    """GET /health, then /info, beside a /predict URL; gives the parsed info. Not healthy, no JSON object, or an info that
    doesn't name the schema is an error."""
    base = url.rstrip("/").removesuffix("/predict")
    with open_(f"{base}/health", timeout=timeout) as response:
        if response.status != 200:
            raise RuntimeError(f"{base}/health says {response.status}")
    with open_(f"{base}/info", timeout=timeout) as response:
        info = json.loads(response.read())
    if not isinstance(info, dict) or not isinstance(info.get("schema_versions"), list) or schema not in info["schema_versions"]:
        raise RuntimeError(f"{base}/info doesn't offer {schema}")
    return info


def first_server_info(answers: DataFrame, ordinal: str, info: str = "server_info") -> DataFrame:
    """One row (server_info): that of the first answer which has any; null if none has."""
    return answers.agg(F.min_by(info, F.when(F.col(info).isNotNull() & ~F.col(info).isin("", "{}"), F.col(ordinal))).alias("server_info"))


def embedded(requests: DataFrame, files: DataFrame, key: str, path: str, default_rate: int = 16000) -> DataFrame:
    """Requests (key, path, sample_rate) with payload_type and data: base64 text of the files (path, content) that are
    there, in one line (by default Spark breaks it after 76 characters), else the path itself; a rate that isn't positive
    is an error of its row, a missing one the default."""
    found = requests.join(files.select(F.col("path").alias(path), "content"), path, "left")
    rate = F.coalesce("sample_rate", F.lit(default_rate))
    inline = F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))
    return found.select(
        key, path, F.when(F.col("content").isNotNull(), "base64_wav").otherwise("file_path").alias("payload_type"),
        F.coalesce(inline, F.col(path)).alias("data"), rate.alias("sample_rate"), F.when(rate < 1, F.concat(F.lit("invalid sample rate "), rate)).alias("error"),
    )


def http_model(url: str) -> Callable[[list[dict]], list[dict]]:
    return lambda part: post(url, {"schema_version": "predictions_v1", "requests": part})["responses"]


def stub(request: Column) -> Column:
    """A deterministic answer for tests without a model."""
    return F.substring(F.sha2(request, 256), 1, 20)


def yes_no_scores(answers: DataFrame, answer: str) -> DataFrame:
    """answers with score (1, 0 or null) and error where the answer is neither."""
    score = parse_yes_no(F.col(answer))
    return answers.withColumn("score", score).withColumn("error", F.when(score.isNull(), F.lit("neither yes nor no")))


def stub_model(part: list[dict]) -> list[dict]:
    """A deterministic model for runs without an endpoint: the same answer to a sample in every process."""
    return [{"sample_id": p["sample_id"], "predictions": [hashlib.sha256(p["sample_id"].encode()).hexdigest()[:20]]} for p in part]


#: judge templates by name; `{{reference}}` and `{{candidate}}` are filled in
JUDGES: dict[str, str] = {
    "equivalence": "Do the two answers mean the same? Reference: {{reference}} Candidate: {{candidate}} Answer YES or NO.",
    "entails": "Does the candidate follow from the reference? Reference: {{reference}} Candidate: {{candidate}} Answer YES or NO.",
    "extract": "Which label does this text name? Text: {{candidate}}",
}


def judge_request(template: str, reference: Column, candidate: Column) -> Column:
    text = F.lit(JUDGES[template])
    for name, value in (("reference", reference), ("candidate", candidate)):
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages")))
