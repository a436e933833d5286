import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import ppm


def brute_model(texts):
    tries = [Counter() for _ in range(ppm.ORDER + 1)]
    for t in texts:
        data = [255] * ppm.ORDER + list(t) + [255]
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                tries[k][tuple(data[i - k : i]), data[i]] += 1
    follow = [{} for _ in tries]
    for k, trie in enumerate(tries):
        for (ctx, s), n in trie.items():
            follow[k].setdefault(ctx, {})[s] = n
    return follow


def brute_log(follow, ctx, symbol):
    out, skip = 0.0, set()
    for k in range(ppm.ORDER, -1, -1):
        own = {s: n for s, n in follow[k].get(tuple(ctx[len(ctx) - k :]), {}).items() if s not in skip}
        if not own:
            continue
        total = 2 * sum(own.values())
        if symbol in own:
            return out + math.log10((2 * own[symbol] - 1) / total)
        out += math.log10(len(own) / total)
        skip |= set(own)
    return out - math.log10(256 - len(skip))


def brute_scores(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    train = [low(t) for _, t, on in rows if on]
    follow = brute_model([t.encode() for t in train])
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", t), None]
    count = Counter(w for t in train for w in tokens(t))
    n, v = count.total(), len(count)
    for d, t, _ in rows:
        t = low(t)
        data = [255] * ppm.ORDER + list(t.encode()) + [255]
        own = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        yield d, len(own), sum(count[w] > 0 for w in own), n, base, sum(brute_log(follow, data[i - ppm.ORDER : i], data[i]) for i in range(ppm.ORDER, len(data)))


def test_probabilities_after_any_context_sum_to_one():
    rng = random.Random(1)
    follow = brute_model([bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 30))) for _ in range(40)])
    for ctx in ([255] * 4, [97, 98, 99, 97], [122] * 4, [99, 122, 97, 98]):
        assert sum(10 ** brute_log(follow, ctx, s) for s in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_scores_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", block)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "é", "x\n", "".join(rng.choice("abc") for _ in range(3))]) for _ in range(rng.randint(0, 30))), rng.random() < 0.7) for i in range(120)]
    rows += [(500, None, True), (501, None, False), (502, "", True), (503, "漢字 Ünseen \U0001f642", False), (None, "the", True), (500, "again", True)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, train boolean, score double").repartition(3)
    got = ppm.score(docs, F.col("train")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    want = sorted(brute_scores(rows), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [x for g in got for x in g[4:]] == pytest.approx([x for w in want for x in w[4:]], rel=1e-5)


def test_without_training_rows_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(docs, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(256)) and got[2].score == pytest.approx(-math.log10(256))
    assert (got[1].n_known, got[1].train_tokens) == (0, 0) and got[2].base_score == pytest.approx(0)
    assert ppm.score(docs.limit(0), F.lit(True)).collect() == []


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    table = ppm.Lookup(keys, np.arange(len(keys)))
    pick = rng.integers(0, len(keys), 20000)
    assert (table.get(keys[pick]) == pick).all()
    same = (np.arange(100, dtype=np.uint64) << np.uint64(61)) | np.uint64(1)
    assert ppm.Lookup(np.zeros(0, np.uint64), np.zeros(0)).get(np.zeros(0, np.uint64)).tolist() == [] and len(same)


def test_query(spark, sf_dir):
    got = ppm.op10_ppm(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs)
    bits = {True: [], False: []}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0
        bits[r.held_out].append((r.score / (len((docs[r.doc_id] or "").encode()) + 1), r.score, r.base_score))
    assert -sum(b[0] for b in bits[True]) / len(bits[True]) * math.log2(10) < 4  # bits a byte
