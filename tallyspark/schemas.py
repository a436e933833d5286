"""Fixed schemas of the record kinds, and the one place where union-typed labels become columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# DDL text, so that importing this needs no session
EXAMPLE = "schema_version string, sample_id string, task_id string, split string, labels string, metadata map<string,string>"
REQUEST = "schema_version string, sample_id string, messages array<struct<role:string,content:string>>, audio_inputs array<struct<payload_type:string,data:string,sample_rate:int>>, generation_config struct<max_tokens:int,temperature:double,max_length_seconds:int>"
PREDICTION = "schema_version string, sample_id string, predictions array<string>, finish_reason string, usage struct<prompt_tokens:int,completion_tokens:int>, latency_sec double, error string, server_info string"
SCORED = "schema_version string, sample_id string, task_id string, predictions array<string>, processed_prediction string, targets string, scores map<string,double>, postprocess_version string, error string"
SUMMARY = "schema_version string, run_id string, n_samples long, n_errors long, mean map<string,double>, per_task_mean map<string,map<string,double>>"
CHECKPOINT = "schema_version string, run_id string, completed_sample_ids array<string>, n_predictions_written long, n_errors long, failures array<struct<sample_id:string,reason:string,stage:string>>"
JUDGE_REQUEST = "sample_id string, rubric string, reference_text string, candidate_text string"
JUDGE_SCORE = "sample_id string, score double, rationale string, error string"
PAIR = "schema_version string, run_id string, model_tag string, subset string, split string, task_id string, task_type string, sample_id string, prompt_id string, ground_truth string, prompt_messages array<struct<role:string,content:string>>, raw_predictions array<string>, processed_prediction string, postprocess_warnings array<string>, error string"
PAYLOAD_TYPES = ("base64_wav", "file_path", "file_url")


def strip(c: Column) -> Column:
    """White space in the Unicode sense taken off both ends; trim() would take spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_labels(json: Column) -> Column:
    """struct(kind, text, list) of labels given as JSON: a string, a list of strings, an object, or null.

    Text that is no JSON counts as the string itself.
    """
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    text = F.when(json.isNull(), None).when(v.isNull(), json).when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>"))
    name = F.when(json.isNull() | (kind == "VOID"), "none").when(v.isNull() | (kind == "STRING"), "text").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("text")
    return F.struct(name.alias("kind"), F.when(name == "text", F.coalesce(text, json)).alias("text"), items.alias("list"))
