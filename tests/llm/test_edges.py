"""Very long texts, repeated and empty rows, and columns whose names clash, for the operators that take documents."""

import random

import pytest

from tallyspark.llm import bpe, decontam, langid, orderminhash, ppm, runbwt, surrogates

EXTRA = "c string, key long, num long, label string, body string, _id string, `a.b` string, TEXTS string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 30000)}" for _ in range(40_000)]
    edited = [w if i % 97 else "edited" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(edited), "", None, "x" * 200_000, "short one", "short one"]
    rows = [(i if i < 6 else 5, t, *["clash", 1, 2, "l", "b", "i", "d", "t"]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


def test_near_duplicates(docs):
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in orderminhash.near_duplicates(docs).collect())
    assert got == [(0, 0, 2), (1, 0, 2), (2, 2, 2), (3, 2, 2), (4, 4, 1), (5, 5, 2), (5, 5, 2)]


def test_decontamination(spark, docs):
    item = " ".join(docs.where("doc_id = 0").first().text.split()[20_000:20_040])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "no such words here at all")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()) == [(0, 1), (1, 1)]
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 5]


def test_language_identification(docs):
    from pyspark.sql import functions as F

    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") < 2, "w").otherwise("x")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[0][0] == got[1][0] == "w" and got[2] == got[3] == ("und", 0.0) and got[4][0] == "x"


def test_scores(docs):
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in ppm.score(docs, F.col("doc_id") != 1).collect()}
    assert got[0].n_tokens == 40_001 and got[2].n_tokens == 1 == got[3].n_tokens and got[4].n_tokens == 2
    assert all(r.score < 0 and r.n_known <= r.n_tokens for r in got.values()) and not got[1].train


def test_removal_of_repeats(docs):
    got = {(r.doc_id, r.n_bytes): r for r in runbwt.remove_repeats(docs).collect()}
    long = next(r for k, r in got.items() if k[0] == 0)
    copy = next(r for k, r in got.items() if k[0] == 1)
    assert long.n_bytes == len(long.kept) and len(copy.kept) < copy.n_bytes / 10
    assert bytes(next(r for k, r in got.items() if k[0] == 4).kept) == b"x"  # every later start repeats the first window


def test_bpe_round_trip(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = bpe.decode(bpe.encode(docs.where("doc_id <> 4"), path, public_tokenizers.PATTERN), path).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in got) == [t for t in texts if t[0] != 4]


def test_surrogates_keep_all_columns(docs):
    out = surrogates.anonymize(docs, b"k")
    assert out.columns == [*docs.columns, "_spans"]
    assert sorted((r.doc_id, r.text or "", r["a.b"], r.c) for r in out.collect()) == sorted((r.doc_id, r.text or "", "d", "clash") for r in docs.collect())
