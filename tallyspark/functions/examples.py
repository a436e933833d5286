"""Examples out of source rows: audio summaries and paths, metadata, renames, messages, reference texts. Columns only;
which of the known columns a table has is looked up in its schema, so one function serves all sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import normalize_labels, strip
from .rows import count_placeholders, keep_last_placeholder, last_message, path_candidates

# Names of source columns.
#: scalars that go into an example's metadata as they are
SCALARS = ("instruction", "instruction_text", "file_name", "source_dataset", "dataset_name", "task", "license", "created_at")
MULTI_SCALARS = ("task", "dataset_name", "source_dataset", "license", "template_path")
#: audio paths in order of preference; after them comes audio.path
PATHS = ("audio_path_16KHz", "audio_path_32KHz", "audio_path_original_sample_rate", "audio_path", "16khz_path", "32khz_path", "gcs_path")
#: source column and the one it fills where that is missing or null
ALIASES = (("16khz_path", "audio_path_16KHz"), ("32khz_path", "audio_path_32KHz"), ("audio_path", "audio_path_original_sample_rate"))


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or null where the table has none of that name."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def _filled(c: Column) -> Column:
    """Text that isn't blank; else null."""
    return F.when(strip(c.cast("string")) != "", c.cast("string"))


def audio_summary(df: DataFrame, name: str = "audio") -> Column:
    """struct(path, sampling_rate, num_samples) of an audio column, without its samples: a struct with any of path,
    sampling_rate and array, or a bare array; null if the table lacks it or nothing is known of it."""
    none = F.lit(None).cast("struct<path:string,sampling_rate:int,num_samples:int>")
    if name not in df.columns:
        return none
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        known = {"num_samples": F.when(c.isNotNull(), F.size(c))}
    elif isinstance(kind, T.StructType):
        has = kind.fieldNames()
        known = {k: c[k] for k in ("path", "sampling_rate") if k in has}
        if "array" in has:
            known["num_samples"] = F.when(c["array"].isNotNull(), F.size(c["array"]))
    else:
        return none
    kinds = {"path": "string", "sampling_rate": "int", "num_samples": "int"}
    parts = [known.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    known_any = reduce(lambda a, b: a | b, (p.isNotNull() for p in parts))
    return F.when(known_any, F.struct(*parts))


def audio_paths(df: DataFrame) -> Column:
    """All paths that a row has for its audio, stripped and distinct, in the order of PATHS, then audio.path."""
    found = [strip(_column(df, p)) for p in PATHS if p in df.columns]
    if "audio" in df.columns and isinstance(df.schema["audio"].dataType, T.StructType) and "path" in df.schema["audio"].dataType.fieldNames():
        found.append(strip(F.col("audio")["path"]))
    return path_candidates(*found) if found else F.array().cast("array<string>")


def scalars(df: DataFrame, names: tuple = SCALARS) -> Column:
    """map of the named columns that hold a string, number or boolean; nulls are left out."""
    own = [n for n in names if n in df.columns and isinstance(df.schema[n].dataType, T.StringType | T.NumericType | T.BooleanType)]
    if not own:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*(x for n in own for x in (F.lit(n), F.col(f"`{n}`").cast("string")))), lambda k, v: v.isNotNull())


def metadata(df: DataFrame) -> Column:
    """struct(audio, audio_path, hf_metadata, scalars): the light part of a row. The audio path is that of the audio, else
    the column audio_path, else null (samples are written out by functions.audio, if anybody wants a file)."""
    audio = audio_summary(df)
    return F.struct(audio.alias("audio"), F.coalesce(_filled(audio["path"]), _filled(_column(df, "audio_path"))).alias("audio_path"), _column(df, "metadata").cast("string").alias("hf_metadata"), scalars(df).alias("scalars"))


def renamed(df: DataFrame, names: dict[str, str] | None) -> DataFrame:
    """Only the columns of names, under their new names; all of df without any."""
    return df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items())) if names else df


def with_aliases(df: DataFrame, root: str | None = None, labels: Column | None = None) -> DataFrame:
    """df with the columns of ALIASES filled from their sources where they are null or missing, data_root if given, and
    output set to labels (array of strings) where it is null, blank or an empty list."""
    for source, target in ALIASES:
        if source in df.columns:
            df = df.withColumn(target, F.coalesce(_column(df, target), _filled(F.col(f"`{source}`"))))
    if root:
        df = df.withColumn("data_root", F.lit(root))
    if labels is not None:
        own = F.when(F.size(labels) > 0, labels)
        if "output" not in df.columns:
            return df.withColumn("output", own)
        if isinstance(df.schema["output"].dataType, T.ArrayType):
            return df.withColumn("output", F.when(F.col("output").isNull() | (F.size("output") == 0), F.coalesce(own, F.col("output"))).otherwise(F.col("output")))
        return df.withColumn("output", F.when(F.coalesce(strip(F.col("output")), F.lit("")) == "", F.coalesce(F.to_json(own), F.col("output"))).otherwise(F.col("output")))
    return df


def _example(sample_id: Column, task_id: str | None, split: str, labels: Column, meta: Column) -> list[Column]:
    return [F.lit("example_v1").alias("schema_version"), sample_id.cast("string").alias("sample_id"), F.lit(task_id).cast("string").alias("task_id"), F.lit(split).alias("split"), labels.alias("labels"), meta.alias("metadata")]


def single_examples(df: DataFrame, sample_id: Column, split: str, task_id: str | None = None, audio_path: Column | None = None, keep: tuple = ()) -> DataFrame:
    """EXAMPLE rows of a single-audio table, and the columns of keep: labels are `output`, or `labels` without such a
    column; an instruction that is missing is taken from instruction_text."""
    path = _filled(F.get(audio_paths(df), F.lit(0)) if audio_path is None else audio_path)
    instruction = F.coalesce(strip(_filled(_column(df, "instruction"))), strip(_filled(_column(df, "instruction_text"))))
    meta = F.map_concat(F.map_filter(F.create_map(F.lit("audio_path"), path), lambda k, v: v.isNotNull()), scalars(df))
    more = F.when(F.try_element_at(meta, F.lit("instruction")).isNull() & instruction.isNotNull(), F.create_map(F.lit("instruction"), instruction)).otherwise(F.create_map().cast("map<string,string>"))
    name = "output" if "output" in df.columns else "labels"
    labels = _column(df, name)
    if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
        labels = F.to_json(labels)
    return df.select(*_example(sample_id, task_id, split, labels, F.map_concat(meta, more)), *keep)


def multi_examples(df: DataFrame, sample_id: Column, paths: Column, split: str, task_id: str | None = None, query: Column | None = None, messages: str = "messages", keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(EXAMPLE rows of a multi-audio table, quarantine (sample_id, problem)). The last user message is the conversation,
    the last assistant message the label; a conversation must have a placeholder for each of its paths."""
    n, talk = F.size(F.coalesce(paths, F.array().cast("array<string>"))), last_message(F.col(messages), "user")
    path = F.coalesce(query if query is not None else F.lit(None).cast("string"), F.try_element_at(paths, F.lit(-1)))
    pairs = {"audio_paths": F.when(n > 0, F.to_json(paths)), "n_audios": F.when(n > 0, n.cast("string")), "audio_path": path, "conversation": talk, "conversation_query_only": keep_last_placeholder(talk)}
    meta = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    slots = F.coalesce(count_placeholders(talk), F.lit(0))
    df = df.withColumn("_problem", F.when(slots != n, F.concat(F.lit("placeholders: "), slots, F.lit(", paths: "), n)))
    good = df.where("_problem IS NULL")
    rows = good.select(*_example(sample_id, task_id, split, last_message(F.col(messages), "assistant"), F.map_concat(meta, scalars(df, MULTI_SCALARS))), *keep)
    return rows, df.where("_problem IS NOT NULL").select(sample_id.cast("string").alias("sample_id"), F.col("_problem").alias("problem"))


def coerced_messages(json: Column) -> Column:
    """struct(messages, error) of a JSON list of messages: each must be an object with role and content, both strings."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    kinds = F.transform(items, lambda m: F.struct(*(F.schema_of_variant(F.try_variant_get(m, f"$.{k}", "variant")).alias(k) for k in ("role", "content"))))
    missing = F.exists(kinds, lambda k: k.role.isNull() | k.content.isNull())
    wrong = F.exists(kinds, lambda k: (k.role != "STRING") | (k.content != "STRING"))
    error = F.when(items.isNull(), "no list of messages").when(missing, "a message lacks role or content").when(wrong, "role and content must be strings")
    messages = F.transform(items, lambda m: F.struct(*(F.try_variant_get(m, f"$.{k}", "string").alias(k) for k in ("role", "content"))))
    return F.struct(F.when(error.isNull(), messages).alias("messages"), error.alias("error"))


def reference_text(labels: Column) -> Column:
    """Labels given as JSON as one text: a string as it is, a list's strings that aren't blank joined by a comma and a
    blank, else empty."""
    x = normalize_labels(labels)
    listed = F.array_join(F.filter(x["list"], lambda s: s.isNotNull() & (strip(s) != "")), ", ")
    return F.when(x["kind"] == "text", x["text"]).when(x["kind"] == "list", listed).otherwise("")
