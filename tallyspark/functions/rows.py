"""Normalising source rows: ids, labels, messages, audio paths, predicates. All Columns, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import strip
from ..sources.sinks import work_dir

PLACEHOLDER = "<Audio><AudioHere></Audio>"
SHOWN = "[audio]"


def text_equals(c: Column, value: str) -> Column:
    return c.eqNullSafe(F.lit(value))


def matches_task(subset: Column, task: Column, wanted: str) -> Column:
    return F.coalesce(subset == wanted, F.lit(False)) | F.coalesce(task == wanted, F.lit(False))


def tier_number(tier: Column) -> Column:
    """The tier as a number, from an integer, digits or `tier_N...`."""
    text = F.lower(strip(tier.cast("string")))
    return F.regexp_extract(text, r"^(?:tier[_ -]?)?(\d+)(?:$|_)", 1).try_cast("int")


def synthetic_id(prefix: str, *parts: Column) -> Column:
    """prefix and the SHA-256 of the parts, zero bytes between them; a null part is empty text."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256))


def resolve_id(candidates: list[Column], fallback: Column) -> Column:
    """The first candidate that isn't blank, stripped."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), F.lit("")) for c in candidates), fallback)


def pick_labels(df: DataFrame) -> Column:
    """`output` if the table has that column (even where it is null), else `labels`."""
    return F.col("output") if "output" in df.columns else F.col("labels") if "labels" in df.columns else F.lit(None).cast("string")


def string_list(c: Column, is_array: bool = False) -> Column:
    """A list of non-empty strings, from an array or JSON text; null if any element isn't one."""
    items = c if is_array else F.from_json(c, "array<string>")
    return F.when(F.forall(items, lambda x: x.isNotNull() & (x != "")), items)


def first_labels(*columns: Column) -> Column:
    """Distinct labels of the first column that has any; text is a JSON list or one label."""
    def listed(c: Column) -> Column:
        items = F.coalesce(F.from_json(c, "array<string>"), F.array(c))
        items = F.array_distinct(F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != "")))
        return F.when(F.size(items) > 0, items)

    return F.coalesce(*(listed(c) for c in columns))


def last_message(messages: Column, role: str) -> Column:
    """The stripped text of the last message of a role; null if blank."""
    return F.nullif(strip(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]), F.lit(""))


def keep_last_placeholder(s: Column, tag: str = PLACEHOLDER, shown: str = SHOWN) -> Column:
    """All placeholders but the last become `[audio]`."""
    tail = F.substring_index(s, tag, -1)
    head = F.substring(s, F.lit(1), F.length(s) - F.length(tail) - len(tag))
    return F.when(F.contains(s, F.lit(tag)), F.concat(F.replace(head, F.lit(tag), F.lit(shown)), F.lit(tag), tail)).otherwise(s)


def count_placeholders(s: Column, tag: str = PLACEHOLDER) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(tag), F.lit("")))) / len(tag)).cast("int")


def choose_paths(context: Column, query: Column, source: Column, n: Column) -> Column:
    """Audio paths of a multi-audio row with n placeholders: the source list if it has n; context and query if they add up
    to n; n context paths whose last one is replaced by the query's."""
    return (
        F.when(F.size(source) == n, source)
        .when(query.isNotNull() & (F.size(context) == n - 1), F.array_append(context, query))
        .when(query.isNotNull() & (F.size(context) == n), F.array_append(F.slice(context, F.lit(1), F.greatest(n - 1, F.lit(0))), query))
        .when(F.size(context) == n, context)
    )


def path_candidates(*columns: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")))


def resolve_path(root: Column, path: Column) -> Column:
    """Absolute paths and URIs stay, relative ones go under the root."""
    return F.when(path.rlike("^(/|[a-z0-9]+://)"), path).otherwise(F.concat_ws("/", F.regexp_replace(root, "/+$", ""), path))


def dotted(json: Column, path: str) -> Column:
    return F.get_json_object(json, "$." + path)


def has_labels(labels: Column) -> Column:
    return F.exists(labels, lambda x: ~F.lower(strip(x)).isin("", "none"))


def model_of_path(path: Column) -> Column:
    """`<model>` of `<model>/suite/...`, else the first two folders."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*?)/suite/", 1), F.lit("")), F.regexp_extract(path, r"^([^/]+/[^/]+)", 1))


def task_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def with_running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with running sums (name: value) over all rows in an order, without bringing all rows to one task.

    Rows are range-partitioned and written to the shared folder once, as both the rows and the partitions' totals are read
    from one and the same division; each partition adds up its own rows and starts where the ones before it end.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    totals = parts.groupBy("_part").agg(*(F.sum(v).alias(f"_{n}") for n, v in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n, v in sums.items():
        parts = parts.withColumn(n, F.sum(v).over(own))
    return parts.join(F.broadcast(totals), "_part").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def with_running_by(df: DataFrame, key: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """with_running within each value of key: running sums over all rows by key and order, less what they are where the
    key begins. A key's rows may be in many tasks. Summands aren't negative."""
    rows = with_running(df, [F.col(key), *order], sums)
    base = rows.groupBy(key).agg(*(F.min(F.col(n) - v).alias(f"_0{n}") for n, v in sums.items()))  # a row for each key
    return rows.join(base, key).select(*df.columns, *((F.col(n) - F.col(f"_0{n}")).alias(n) for n in sums))


def with_ordinal(df: DataFrame, *by: str, name: str = "ordinal") -> DataFrame:
    """df with the 0-based place of each row in the order of `by`."""
    return with_running(df, list(by), {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def build_request(system: str, template: str, fields: dict[str, Column], audio: Column | None = None, rate: int = 16000) -> Column:
    """struct(messages, audio_inputs): the template's `{{name}}` replaced by fields; error text if slots don't match."""
    text = F.lit(template)
    for name, value in fields.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    inputs = F.transform(audio, lambda p: F.struct(F.lit("file_path").alias("payload_type"), p.alias("data"), F.lit(rate).alias("sample_rate"))) if audio is not None else F.array().cast("array<struct<payload_type:string,data:string,sample_rate:int>>")
    error = F.when(count_placeholders(text) != F.size(inputs), F.lit("audio slots and inputs differ in number"))
    return F.struct(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"), inputs.alias("audio_inputs"), error.alias("error"))
