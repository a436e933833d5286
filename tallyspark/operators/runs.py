"""Run management: joins between samples, predictions and artifacts; selection; tables; sampling; caching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key: the last by ordinal; an aggregation, so hot keys are combined in every task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_r")).select(key, "_r.*")


def with_targets(predictions: DataFrame, targets: DataFrame, key: str = "sample_id", ordinal: str = "ordinal") -> DataFrame:
    """Predictions with their targets; of repeated targets the last one counts."""
    return predictions.join(last_by(targets, key, ordinal).drop(ordinal), key, "left")


def checked_pairs(requests: DataFrame, responses: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, problems): ids must be the same on both sides and unique; problems are rows (key, problem)."""
    a = requests.groupBy(key).agg(F.count("*").alias("_a"))
    b = responses.groupBy(key).agg(F.count("*").alias("_b"))
    both = a.join(b, key, "full")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated")
    return requests.join(responses, key), both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def pending(examples: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """Examples that are still to do."""
    return examples.join(done.select(key), key, "left_anti")


def chosen(examples: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return examples.join(ids.select(key), key, "left_semi")


def plan_items(models: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every model with every task; both are registries of a few rows."""
    return models.crossJoin(F.broadcast(tasks))


def by_endpoint(items: DataFrame, url: str, ordinal: str) -> DataFrame:
    return items.groupBy(url).agg(F.min(ordinal).alias("first"), F.count("*").alias("n"))


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct and repeated ids on both sides, ids missing on either, and whether they are one to one."""
    x = a.groupBy(key).agg(F.count("*").alias("na")).join(b.groupBy(key).agg(F.count("*").alias("nb")), key, "full")
    s = x.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"),
        F.count("na").alias("ids_a"),
        F.count("nb").alias("ids_b"),
        F.count_if(F.col("na") > 1).alias("repeated_a"),
        F.count_if(F.col("nb") > 1).alias("repeated_b"),
        F.count_if(F.col("nb").isNull()).alias("only_a"),
        F.count_if(F.col("na").isNull()).alias("only_b"),
    )
    return s.withColumn("one_to_one", (F.col("only_a") + F.col("only_b") + F.col("repeated_a") + F.col("repeated_b")) == 0)


def winners(runs: DataFrame, keys: list[str], expected: str, rows: str, mtime: str, path: str) -> DataFrame:
    """The run of each group: full coverage first, then (among partial ones) most rows, then newest, then path."""
    full = F.col(rows) >= F.col(expected)
    rank = F.struct(full.alias("full"), F.when(full, F.lit(0)).otherwise(F.col(rows)).alias("rows"), F.col(mtime), F.col(path))
    return runs.groupBy(*keys).agg(F.max_by(F.struct(path, rows, full.alias("full")), rank).alias("w")).select(*keys, "w.*")


def merged(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, ids that repeat and how often)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, out.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def pick_metric(scores: Column, preferred: list[str]) -> Column:
    """The first of the preferred metrics that there is."""
    return F.coalesce(*(F.try_element_at(scores, F.lit(p)) for p in preferred))


def results_table(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A pivot with fixed columns, and how many of them each row has."""
    table = df.groupBy(row).pivot(column, columns).agg(F.first(value, ignorenulls=True))
    n = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    return table.withColumn("covered", F.concat(n, F.lit(f"/{len(columns)}")))


def first_k(df: DataFrame, k: int, by: str, order: list[str]) -> DataFrame:
    """The first k rows of each group; every task keeps its own first k before the groups meet."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def sample_k(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows in the order of a digest of seed and key: the same ones for any partitioning."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(k)


def stratified(df: DataFrame, positive: Column, k: int, least_positive: int, order: str) -> DataFrame:
    """k rows by order, at least least_positive of them positive if there are so many."""
    df = df.withColumn("_pos", F.coalesce(positive, F.lit(False)))
    w = Window.partitionBy("_pos").orderBy(order)
    best = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    must = F.col("_pos") & (F.col("_r") <= least_positive)
    return best.orderBy(F.when(must, 0).otherwise(1), F.col("_pos").cast("int"), order).limit(k).drop("_r", "_pos")


def batches(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(ordinal) / size))


def batch_size(advertised: int | None, requested: int | None, supported: bool = True, most: int = 512) -> int:
    """What a server and a user allow; 8 if nobody says, 1 if the server takes no batches."""
    if not supported:
        return 1
    sizes = [s for s in (advertised, requested) if s]
    return max(1, min(sizes)) if sizes else min(8, most)


def cache_key(kind: str, **fields: Column) -> Column:
    """Digest of the canonical JSON of the fields, marked by kind and version."""
    from ..sources.sinks import canonical_json

    return F.sha2(F.concat(F.lit(f"{kind}:v1:"), canonical_json(**fields)), 256)


def store(values: DataFrame, path: str, key: str = "key") -> None:
    """Append (key, value, error) to a cache table, numbered after all that it has; rows with an error aren't stored. The
    table is read as the last value of each key."""
    from ..sources.sinks import exists

    spark = values.sparkSession
    last = spark.read.parquet(path).agg(F.max("ordinal")).first()[0] if exists(spark, path) else None
    good = values.where("error IS NULL") if "error" in values.columns else values
    good.select(key, "value", F.lit((last if last is not None else -1) + 1).cast("long").alias("ordinal")).dropDuplicates([key]).write.mode("append").parquet(path)


def with_dimension(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """df with what a registry says of each key (expected rows, longest clip, fixed labels); null where it says nothing. A
    registry has a row for each task or subset."""
    return df.join(F.broadcast(dimension), key, "left")


def cached(requests: DataFrame, store: DataFrame, key: str = "key", ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(requests with a stored value, those without); the last value stored under a key counts, errors are never stored."""
    have = last_by(store, key, ordinal).drop(ordinal)
    return requests.join(have, key), requests.join(have.select(key), key, "left_anti")
