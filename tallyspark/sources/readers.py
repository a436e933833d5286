"""Readers: everything is a scan with an explicit schema, so filters and columns reach the files."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.examples import audio_paths, multi_examples, renamed, single_examples, with_aliases
from ..functions.rows import choose_paths, count_placeholders, last_message, resolve_id, resolve_path, synthetic_id, with_ordinal
from ..schemas import strip

READERS: dict[str, Callable] = {}


def reader(name: str):
    def register(f: Callable) -> Callable:
        READERS[name] = f
        return f

    return register


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise KeyError(f"no reader {kind!r}; there are {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


@reader("parquet")
def parquet(spark: SparkSession, path: str, split: str | None = None, subset: str | None = None, columns: list[str] | None = None, order: list[str] | None = None, where=None, limit: int | None = None, after_filter: bool = False) -> DataFrame:
    """A Parquet table; order numbers the rows, before the filters or after them, as a stream would."""
    df = spark.read.parquet(path)
    keep = F.lit(True)
    if split is not None and "split" in df.columns:
        keep = keep & (F.col("split") == split)
    if subset is not None:
        keep = keep & ((F.col("subset") == subset) | (F.col("task") == subset) if {"subset", "task"} <= set(df.columns) else F.col("subset") == subset)
    if where is not None:
        keep = keep & where
    names = columns or df.columns
    if order and after_filter:
        more = [c for c in order if c not in names]
        df = with_ordinal(df.where(keep).select(*names, *more), *order).drop(*more)
    elif order:
        # what the filter says is a column of its own, so only the columns that come out are numbered and written
        more = [c for c in order if c not in names]
        df = with_ordinal(df.select(*names, *more, keep.alias("_keep")), *order).where("_keep").drop("_keep", *more)
    else:
        df = df.where(keep).select(*names)
    return df.limit(limit) if limit else df


@reader("multi_audio")
def multi_audio(spark: SparkSession, path: str, split: str = "test", task_id: str | None = None, task: str | None = None, names: dict[str, str] | None = None, fmt: str = "parquet", schema: str | None = None, root: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(examples, quarantine) of a table with context_source_paths, query_source_path or source_audio_paths and messages,
    from Parquet or JSON lines; the paths are put under root."""
    df = read(spark, "jsonl", path, schema=schema) if fmt == "jsonl" else spark.read.parquet(path)
    df = renamed(df, names)
    if task is not None and "task" in df.columns:
        df = df.where(F.col("task") == task)
    if limit:
        df = df.limit(limit)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in df.columns else F.array().cast("array<string>")
    query = F.coalesce(*(F.col(c) for c in ("query_source_path", "query_audio_path") if c in df.columns), F.lit(None).cast("string"))
    context = F.when(F.size(listed("context_source_paths")) > 0, listed("context_source_paths")).otherwise(listed("context_audio_paths"))
    paths = choose_paths(context, query, listed("source_audio_paths"), count_placeholders(last_message(F.col("messages"), "user")))
    under = F.transform(paths, lambda p: resolve_path(F.lit(root), p)) if root else paths
    key = resolve_id([F.col("id")] if "id" in df.columns else [], synthetic_id("row:", F.to_json("messages")))
    return multi_examples(df.withColumn("_paths", under), key, F.col("_paths"), split, task_id)


@reader("single_audio")
def single_audio(spark: SparkSession, path: str, split: str = "test", task_id: str | None = None, task: str | None = None, names: dict[str, str] | None = None, fmt: str = "parquet", schema: str | None = None, root: str | None = None, limit: int | None = None) -> DataFrame:
    """Examples of a table with one audio a row, from Parquet or JSON lines; the path is put under root."""
    df = with_aliases(renamed(read(spark, "jsonl", path, schema=schema) if fmt == "jsonl" else spark.read.parquet(path), names))
    if task is not None and "task" in df.columns:
        df = df.where(F.col("task") == task)
    if limit:
        df = df.limit(limit)
    first = F.get(audio_paths(df), F.lit(0))
    key = resolve_id([F.col("id")] if "id" in df.columns else [], synthetic_id("row:", *(F.col(c) for c in ("dataset_name", "file_name") if c in df.columns)))
    return single_examples(df, key, split, task_id, resolve_path(F.lit(root), first) if root else first)


#: tiers whose subsets have several audios a row
MULTI_TIERS = frozenset({4})


def front_door(spark: SparkSession, catalog: dict[str, int], path: str, subset: str, **options):
    """The examples of a subset, by the reader that its tier in the catalog (subset: tier) asks for; a subset that the
    catalog doesn't have is a KeyError. Multi-audio subsets give (examples, quarantine)."""
    name = subset.strip()
    if name not in catalog:
        raise KeyError(f"unknown subset {subset!r}; there are {', '.join(sorted(catalog))}")
    return read(spark, "multi_audio" if catalog[name] in MULTI_TIERS else "single_audio", path, task=name, **options)


#: names of backends that are one
BACKENDS = {"hf": "huggingface"}


def backend(cli: str | None = None, config: dict | None = None, env: dict | None = None, default: str = "parquet", variable: str = "TALLYSPARK_BACKEND") -> str:
    """The reader's name: the command line's, else the task file's (key `backend`), else the environment's, else default;
    blanks count as nothing said."""
    env = os.environ if env is None else env
    said = next((x.strip().lower() for x in (cli, (config or {}).get("backend"), env.get(variable)) if x and x.strip()), default)
    said = BACKENDS.get(said, said)
    if said not in {*READERS, *BACKENDS.values()}:
        raise KeyError(f"no backend {said!r}; there are {sorted({*READERS, *BACKENDS.values()})}")
    return said


@reader("jsonl")
def jsonl(spark: SparkSession, path: str, schema: str, keep_malformed: bool = False, root: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones dropped or kept as rows with `_corrupt` text. names: the columns
    to give, by what they are called in the file."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    df = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    if root is not None:
        df = df.withColumn("data_root", F.lit(root))
    if not keep_malformed:
        df = df.where("_corrupt IS NULL").drop("_corrupt")
    return renamed(df, names if not names or not keep_malformed else {**names, "_corrupt": "_corrupt"})


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows) of a table read with keep_malformed."""
    return df.where("_corrupt IS NULL").drop("_corrupt"), df.where("_corrupt IS NOT NULL").select("_corrupt")


@reader("run_files")
def run_files(spark: SparkSession, path: str, schema: str, name: str = "predictions.jsonl") -> DataFrame:
    """All artifacts of a name under a folder, each row with its `path` below it and its line number in the file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime")).where(strip(F.col("value")) != "")
    below = F.regexp_replace(F.substring_index("file", path.rstrip("/") + "/", -1), "^/+", "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.select(below.alias("path"), "mtime", row.alias("row"), F.try_parse_json("value").isNull().alias("malformed"))


@reader("taxonomy")
def taxonomy(spark: SparkSession, path: str, code: str = "SPECIES_CODE", name: str = "SCI_NAME", overlay: DataFrame | None = None) -> DataFrame:
    """(code, name), both stripped and required; codes of the overlay are added where the file lacks them."""
    df = spark.read.option("header", "true").csv(path).select(strip(F.col(code)).alias("code"), strip(F.col(name)).alias("name")).where("code != '' AND name != ''")
    return df if overlay is None else df.unionByName(overlay.select("code", "name").join(df, "code", "left_anti"))


def codes_to_names(df: DataFrame, key: str, codes: str, taxonomy: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(key, names): distinct names of an array of codes, in its order; synonyms become their canonical name."""
    x = df.select(key, F.posexplode(codes).alias("pos", "code")).join(F.broadcast(taxonomy), "code")
    if synonyms:
        x = x.withColumn("name", F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in synonyms.items() for v in kv)), F.col("name")), F.col("name")))
    return x.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"])).alias("names"))


def audio_for(ids: DataFrame, audio: DataFrame, key: str = "audio_id") -> tuple[DataFrame, DataFrame]:
    """(audio rows that are needed, ids that have none)."""
    wanted = ids.select(key).distinct()
    return audio.join(wanted, key, "left_semi"), wanted.join(audio, key, "left_anti")


def registry(folder: str) -> dict[str, dict[str, dict]]:
    """kind -> id -> document, from `<folder>/<kind>/*.yaml` in sorted order; later files override equal ids."""
    import yaml

    out: dict[str, dict[str, dict]] = {}
    for kind in sorted(os.listdir(folder)):
        if os.path.isdir(os.path.join(folder, kind)):
            out[kind] = {}
            for file in sorted(os.listdir(os.path.join(folder, kind))):
                if file.endswith((".yaml", ".yml")):
                    with open(os.path.join(folder, kind, file), encoding="utf-8") as f:
                        doc = yaml.safe_load(f) or {}
                    if not isinstance(doc, dict):
                        raise ValueError(f"{kind}/{file} is no mapping")
                    nested = doc and all(isinstance(v, dict) for v in doc.values())
                    out[kind].update(doc if nested else {str(doc.get("id", file.rsplit(".", 1)[0])): doc})
    return out
