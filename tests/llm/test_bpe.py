import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tallyspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe.read_ranks(PATH)), special_tokens={})


def test_same_ids_as_the_library_and_exact_round_trip(spark, encoding):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n  x", "it's  42 <|endoftext|>", "é" * 5000, "漢字 かな 🙂🙂", "a" * 30000, "the the the " * 4000]
    texts += ["".join(rng.choice("ab é'\n \t1!漢\x00 ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)] + [(1, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = sorted(((d is None, d or 0), tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for d, t, _ in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(r.ids), bytes(r.decoded)) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect() == []


def test_query_against_the_library(spark, sf_dir, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.op8_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
