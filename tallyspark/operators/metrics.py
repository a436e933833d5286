"""Metrics as aggregations: one row out, partial aggregation before every shuffle, no driver loops."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import with_running, with_running_by
from ..functions.text import let, lits, normalize_whitespace
from ..schemas import strip

METRICS: dict[str, Callable] = {}


def metric(f: Callable) -> Callable:
    """Register a metric by its name; a second one of that name is an error."""
    if f.__name__ in METRICS:
        raise ValueError(f"metric {f.__name__} exists")
    METRICS[f.__name__] = f
    return f


def ratio(a: Column, b: Column, zero: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(float(zero)))


def counts(df: DataFrame, pred: str, target: str, dense: bool = False) -> DataFrame:
    """(label, tp, fp, fn) of single labels; dense: a row for every integer from 0 to the largest, also unseen ones."""
    both = df.select(F.explode(F.array(F.struct(F.col(pred).alias("label"), (F.col(pred) == F.col(target)).cast("long").alias("tp"), (F.col(pred) != F.col(target)).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")), F.struct(F.col(target).alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col(pred) != F.col(target)).cast("long").alias("fn")))).alias("x")).select("x.*")
    out = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    if dense:
        every = out.agg(F.max("label").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.col("m").cast("int"))).alias("label"))
        out = every.join(out, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    return out


def counts_multi(df: DataFrame, pred: str, target: str) -> DataFrame:
    """(label, tp, fp, fn) of arrays of labels."""
    hit = F.transform(F.array_union(pred, target), lambda x: F.struct(x.alias("label"), F.array_contains(pred, x).alias("p"), F.array_contains(target, x).alias("t")))
    x = df.select(F.explode(hit).alias("x")).select("x.*")
    return x.groupBy("label").agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(~F.col("p") & F.col("t")).alias("fn"))


def prf(tp: Column, fp: Column, fn: Column, zero: float = 0.0) -> list[Column]:
    p, r = ratio(tp, tp + fp, zero), ratio(tp, tp + fn, zero)
    return [p, r, F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(F.lit(float(zero)))]


def averaged(per_label: DataFrame, average: str = "macro", zero: float = 0.0) -> DataFrame:
    """(precision, recall, f1) from (label, tp, fp, fn)."""
    names = ("precision", "recall", "f1")
    if average in ("micro", "binary"):
        rows = per_label.where(F.col("label") == 1) if average == "binary" else per_label
        s = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
        return s.select(*(c.alias(n) for c, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn"), zero), names, strict=True)))
    each = per_label.select(*(c.alias(n) for c, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn"), zero), names, strict=True)), (F.col("tp") + F.col("fn")).alias("support"))
    if average == "macro":
        return each.agg(*(F.avg(n).alias(n) for n in names))
    if average == "weighted":
        return each.agg(*(F.coalesce(F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")), F.lit(float(zero))).alias(n) for n in names))
    raise ValueError(f"unknown average: {average}")


@metric
def accuracy(df: DataFrame, pred: str, target: str) -> DataFrame:
    """The share of equal rows; arrays are equal as sets."""
    kind = dict(df.dtypes)[pred]
    a, b = (F.array_sort(pred), F.array_sort(target)) if kind.startswith("array") else (F.col(pred), F.col(target))
    return df.agg(F.avg(a.eqNullSafe(b).cast("double")).alias("accuracy"))


def _one(name: str):
    def f(df: DataFrame, pred: str, target: str, average: str = "macro", zero: float = 0.0) -> DataFrame:
        return averaged(counts(df, pred, target), average, zero).select(name)

    f.__name__ = name
    return metric(f)


precision, recall, f1 = _one("precision"), _one("recall"), _one("f1")


def any_of(pred: Column, target: Column, sep: str = ",") -> Column:
    """Whether the answer is one of the target's options."""
    return F.array_contains(F.transform(F.split(target, sep), strip), pred)


@metric
def top1_accuracy(df: DataFrame, pred: str, target: str) -> DataFrame:
    return df.agg(F.avg(any_of(F.col(pred), F.col(target)).cast("double")).alias("top1_accuracy"))


@metric
def average_precision(df: DataFrame, label: str, score: str, truth: str, ordinal: str, average: str = "macro") -> DataFrame:
    """Average precision over long rows (label, score, truth 0/1); equal scores stand in the order of ordinal, and a label
    without a positive counts as 0. Rows are ranked by range partition, so that a frequent label is in many tasks."""
    order = [F.desc(score), F.col(ordinal), F.col(label)]
    sums = {"_rank": F.lit(1).cast("long"), "_tp": F.col(truth).cast("long")}
    if average == "micro":
        ranked, keys = with_running(df, order, sums), []
    else:
        ranked, keys = with_running_by(df, label, order[:2], sums), [label]
    each = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(truth) == 1, F.col("_tp") / F.col("_rank"))).alias("s"), F.sum(truth).alias("p"))
    return each.agg(F.avg(F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(0.0)).alias("average_precision"))


@metric
def macro_f1(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Macro F1 over the classes of both columns; 0 without rows."""
    return averaged(counts(df, pred, target)).select(F.coalesce("f1", F.lit(0.0)).alias("macro_f1"))


@metric
def dataset_map(df: DataFrame, pred: str, target: str, ordinal: str) -> DataFrame:
    """Mean average precision of predicted label sets (scores 0 or 1), from predicted and true pairs only.

    A predicted sample ranks among the label's predicted ones by ordinal. A missed positive comes after all of them: with
    o samples before it, of which k are predicted, its rank is n_pred + o - k + 1. No sample-by-label matrix is made.
    """
    base = df.select(F.col(ordinal).alias("_o"), F.array_distinct(F.filter(pred, lambda x: strip(x) != "")).alias("_p"), F.array_distinct(F.filter(target, lambda x: strip(x) != "")).alias("_t"))
    hit = F.transform(F.array_union("_p", "_t"), lambda x: F.struct(x.alias("label"), F.array_contains("_p", x).cast("int").alias("p"), F.array_contains("_t", x).cast("int").alias("t")))
    rows = base.select("_o", F.explode(hit).alias("x")).select("_o", "x.*")
    rows = with_running_by(rows, "label", ["_o"], {"k": F.col("p").cast("long"), "ptp": (F.col("p") * F.col("t")).cast("long"), "missed": ((1 - F.col("p")) * F.col("t")).cast("long")})
    rows = rows.join(rows.groupBy("label").agg(F.sum("p").alias("n"), F.sum(F.col("p") * F.col("t")).alias("pt")), "label")
    rank = F.when(F.col("p") == 1, F.col("k")).otherwise(F.col("n") + F.col("_o") - F.col("k") + 1)
    tp = F.when(F.col("p") == 1, F.col("ptp")).otherwise(F.col("pt") + F.col("missed"))
    each = rows.groupBy("label").agg(F.sum(F.when(F.col("t") == 1, tp / rank).otherwise(0.0)).alias("s"), F.sum("t").alias("pos"))
    return each.agg(F.coalesce(F.avg(ratio(F.col("s"), F.col("pos"))), F.lit(0.0)).alias("dataset_map"))


def ngram_counts(df: DataFrame, key: str, text: str, n_max: int = 4) -> DataFrame:
    """(key, n, gram, tf) of the word n-grams of a text, split at white space."""
    tokens = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda x: x != "")

    def grams(t: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, i, n), " ").alias("gram")))

        return F.concat(*(of(n) for n in range(1, n_max + 1)))

    return df.select(key, F.explode(let(tokens, grams)).alias("x")).groupBy(key, "x.n", "x.gram").agg(F.count("*").alias("tf"))


def cider_samples(df: DataFrame, key: str, pred: str, target: str) -> DataFrame:
    """(key, cider) of each pair; key is unique. tf-idf of 1- to 4-grams with document frequencies over the targets, counts
    clipped to the reference, and a Gaussian penalty on the difference in bigrams."""
    total = df.agg(F.count("*").alias("_N"))
    hyp = ngram_counts(df, key, pred)
    ref = ngram_counts(df, key, target)
    idf = ref.groupBy("n", "gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("n", "gram", (F.ln("_N") - F.ln(F.greatest("df", F.lit(1)))).alias("idf"))
    idf_all = hyp.select("n", "gram").unionByName(ref.select("n", "gram")).distinct().join(idf, ["n", "gram"], "left").crossJoin(F.broadcast(total)).select("n", "gram", F.coalesce("idf", F.ln("_N")).alias("idf"))
    both = hyp.withColumnRenamed("tf", "h").join(ref.withColumnRenamed("tf", "r"), [key, "n", "gram"], "full").na.fill(0, ["h", "r"]).join(idf_all, ["n", "gram"])
    wh, wr = F.col("h") * F.col("idf"), F.col("r") * F.col("idf")
    per = both.groupBy(key, "n").agg(F.sum(F.least(wh, wr) * wr).alias("dot"), F.sqrt(F.sum(wh * wh)).alias("nh"), F.sqrt(F.sum(wr * wr)).alias("nr"), (F.sum("h") - F.sum("r")).alias("d"))
    sim = F.when((F.col("nh") != 0) & (F.col("nr") != 0), F.col("dot") / (F.col("nh") * F.col("nr"))).otherwise(F.col("dot"))
    score = per.groupBy(key).agg(F.sum(sim).alias("s"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("d"))), F.lit(0)).alias("d"))
    score = score.select(key, (10 * F.col("s") / 4 * F.exp(-(F.col("d") * F.col("d")) / 72.0)).alias("cider"))
    return df.select(key).join(score, key, "left").na.fill(0.0, ["cider"])


@metric
def cider(df: DataFrame, key: str, pred: str, target: str) -> DataFrame:
    """The corpus mean of cider_samples; 0 for fewer than two pairs."""
    return cider_samples(df, key, pred, target).agg(F.when(F.count("*") >= 2, F.avg("cider")).otherwise(0.0).alias("cider"))


@metric
def spider(df: DataFrame, key: str, pred: str, target: str, spice: DataFrame | None = None) -> DataFrame:
    """The mean of cider over 10 and SPICE, and whether SPICE is in it. spice is one row (spice) from its own external
    program; without it SPICE counts as 0, as where that program can't run, and a warning says so."""
    if spice is None:
        warnings.warn("spider without SPICE is half of cider over 10", stacklevel=2)
        return cider(df, key, pred, target).select((F.col("cider") / 10 / 2).alias("spider"), F.lit(False).alias("has_spice"))
    both = cider(df, key, pred, target).crossJoin(F.broadcast(spice.select("spice").limit(1)))  # a row and a row
    return both.select(((F.col("cider") / 10 + F.col("spice")) / 2).alias("spider"), F.lit(True).alias("has_spice"))


def score_sample(processed: Column, raw: Column, kind: Column, text: Column, items: Column, task: Column) -> Column:
    """map<string,double> of one sample, by the kind of its labels ('text', 'list') and its task."""
    answer = F.when(processed != "", processed).otherwise(raw)
    task = F.lower(F.coalesce(task, F.lit("")))
    pairs = lambda *kv: F.create_map(*(x for k, v in kv for x in (F.lit(k), v.cast("double"))))
    a, b = normalize_whitespace(answer), normalize_whitespace(text)
    exact = F.when(b == "", F.lit(0.0)).otherwise((a == b).cast("double"))
    single = pairs(*((n, exact) for n in ("accuracy", "top1_accuracy", "precision", "recall", "f1")))
    options = any_of(a, F.array_join(F.transform(items, normalize_whitespace), ","))
    p = F.array_distinct(F.filter(F.transform(F.split(answer, ","), normalize_whitespace), lambda x: x != ""))
    t = F.array_distinct(F.filter(F.transform(items, normalize_whitespace), lambda x: x != ""))
    hit, union = F.size(F.array_intersect(p, t)), F.size(F.array_union(p, t))
    pr, rc = ratio(hit, F.size(p)), ratio(hit, F.size(t))
    sets = F.when(union > 0, pairs(("average_precision", F.size(t) / union), ("precision", pr), ("recall", rc), ("f1", F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0))))
    one_of = (task.contains("classification") | task.contains("open_ended")) & ~task.contains("detection")
    none = F.create_map().cast("map<string,double>")
    return F.coalesce(F.when((kind == "text") & ~task.contains("caption"), single).when((kind == "list") & one_of, pairs(("accuracy", options), ("top1_accuracy", options))).when(kind == "list", sets), none)


def score_means(df: DataFrame, scores: str, by: str | None = None) -> DataFrame:
    """The mean of each key over the rows that have it; by: within each task, null being `default`."""
    keys = [F.coalesce(F.col(by), F.lit("default")).alias(by)] if by else []
    return df.select(*keys, F.explode(scores).alias("metric", "value")).groupBy(*([by] if by else []), "metric").agg(F.avg("value").alias("mean"))


def dataset_metric(df: DataFrame, task_type: str, pred: str, target: str, ordinal: str) -> DataFrame | None:
    """The corpus metric of a task type: macro F1, mAP or CIDEr; None for others, and with a warning where the columns
    don't allow it."""
    try:
        if task_type == "classification":
            return macro_f1(df, pred, target)
        if task_type == "detection":
            return dataset_map(df.withColumn("_p", F.transform(F.split(pred, ","), strip)).withColumn("_t", F.transform(F.split(target, ","), strip)), "_p", "_t", ordinal)
        return cider(df, ordinal, pred, target) if task_type == "captioning" else None
    except AnalysisException as error:
        warnings.warn(f"no corpus metric for {task_type}: {str(error).splitlines()[0]}", stacklevel=2)
        return None


def vocabulary(df: DataFrame, text: str, ordinal: str) -> DataFrame:
    """(token, first) of comma-parted labels in the order first seen."""
    x = df.select(ordinal, F.posexplode(F.transform(F.split(text, ","), strip)).alias("pos", "token")).where("token != ''")
    return x.groupBy("token").agg(F.min(F.struct(ordinal, "pos")).alias("first"))


__all__ = [*METRICS, "METRICS", "averaged", "counts", "counts_multi", "lits", "score_means", "score_sample", "vocabulary"]
