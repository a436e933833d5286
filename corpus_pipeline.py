"""A corpus pipeline over documents: (name, function) stages, each (spark, docs, sf_dir) -> DataFrame.

Each stage's result is written as Parquet and read again as the next one's docs; all but the last keep the columns of
documents. Quality rules drop what they reject, of near-duplicates the row with the class's least id stays,
decontamination drops documents with a copy of a benchmark item, personal data get surrogates, and the last stage gives
the ids of each text and the bytes read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontam, orderminhash, quality, surrogates
from tallyspark.llm.common import materialize, without

#: after four other stages, executors have less memory to spare than for BPE alone
BPE_BLOCK_BYTES = 4 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of its least id and, of rows with this id, one of the least content."""
    classes = orderminhash.near_duplicates(docs.select("doc_id", "text")).where("class_size > 1")
    own = F.col("doc_id").eqNullSafe(F.col("class_id"))
    stays = classes.where(own).groupBy("class").agg(F.min("c").alias("_stays"))
    marked = materialize(classes.join(stays, "class").select("doc_id", "c", (own & (F.col("c") == F.col("_stays"))).alias("keep")))
    key = orderminhash.content(F.col("text"))
    match = (key == F.col("_c")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    pairs = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("c").alias("_c"))
    rows = without(docs, pairs(marked.where("NOT keep")).distinct(), match)
    # rows that repeat both id and text are one
    again = pairs(marked.where("keep")).groupBy("_id", "_c").count().where("count > 1").drop("count")
    if again.limit(1).count() == 0:
        return rows
    one = rows.join(again, match, "left_semi").withColumn("_key", key).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return without(rows, again, match).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where a surrogate is of another length."""
    out = surrogates.anonymize(docs, surrogates.session_key(spark))
    out = out.drop(out.columns[-1])
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=BPE_BLOCK_BYTES), path).select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", hide_personal_data),
    ("byte-level BPE", encode),
]

#: near-duplicates, alignment, surrogates and BPE are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
