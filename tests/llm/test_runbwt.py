import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import runbwt as r


def brute(docs):
    """(kept bytes, spans) of each document, in the given order."""
    seen, out = set(), []
    for raw in docs:
        cover = [False] * len(raw)
        for i in range(len(raw) - r.LENGTH + 1):
            w = raw[i : i + r.LENGTH]
            if w in seen:
                cover[i : i + r.LENGTH] = [True] * r.LENGTH
            seen.add(w)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((bytes(b for b, c in zip(raw, cover, strict=True) if not c), spans))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12), min_size=1, max_size=6), st.integers(1, 6))
def test_index_against_brute_force(texts, length):
    symbols = np.concatenate([np.array([*(ord(c) for c in t), 0], dtype=np.uint16) for t in texts])
    index = r.RunLengthIndex(symbols)
    whole = "".join(t + "\0" for t in texts)
    ends = {i for i, c in enumerate(whole) if c == "\0"}
    order = sorted(range(len(whole)), key=lambda i: (whole[i : min(e for e in ends if e >= i)] + "\0", i))
    assert r.suffix_order(symbols).tolist() == order
    assert index.length.sum() == len(whole) and len(index.head) == len(index.symbol) <= len(whole)
    neighbour, match = index.stream()
    place = {p: i for i, p in enumerate(order)}
    for p in range(len(whole)):
        if place[p]:
            q = order[place[p] - 1]
            n = 0
            while whole[p + n] == whole[q + n] != "\0":
                n += 1
            assert (neighbour[p], match[p]) == (q, n)
    want = [any(whole[q : q + length] == whole[p : p + length] for q in range(p)) and "\0" not in whole[p : p + length] and p + length <= len(whole) for p in range(len(whole))]
    assert index.repeats(length).tolist() == want


def corpus(rng, n):
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [prose(60) for _ in range(4)]
    docs = []
    for _ in range(n):
        t = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 100)
            t = t + rng.choice(["", " ", "\n"]) + p[a : a + rng.randint(60, 400)] + prose(rng.randint(0, 20))
        docs.append(t)
    return [*docs, docs[0], docs[3], "x" * 400, "ab" * 300, "", "short"]


@pytest.mark.parametrize(("block", "index"), [(3000, 1 << 20), (1 << 20, 2000)])
def test_against_brute_force(spark, monkeypatch, block, index):
    monkeypatch.setattr(r, "BLOCK_BYTES", block)
    monkeypatch.setattr(r, "INDEX_BYTES", index)
    texts = corpus(random.Random(block), 80)
    rows = [(i * 7 - 100, t, b"k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string, kept binary").repartition(4)
    want = {d: w for (d, _, _), w in zip(rows, brute([t.encode() for t in texts]), strict=True)}
    got = r.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (bytes(x.kept), len(x.spans)) == want[x.doc_id]
        assert x.n_bytes == len(texts[(x.doc_id + 100) // 7].encode())


def test_split_groups_are_exact(monkeypatch):
    rng = random.Random(5)
    core = "".join(rng.choice("abcdefgh") for _ in range(150))
    segs = [("".join(rng.choice("ab") for _ in range(30)) + core)[rng.randint(0, 60) :][: rng.randint(100, 150)].encode() for _ in range(200)]
    place = [s.find(core[60:100].encode()) for s in segs]
    segs, place = zip(*[(s, p) for s, p in zip(segs, place, strict=True) if p >= 0 and len(s) >= 100], strict=True)
    want = r.masks_of(list(segs))
    monkeypatch.setattr(r, "INDEX_BYTES", 3000)
    got = r.group_masks(list(segs), list(place))
    for s, p, a, b in zip(segs, place, want, got, strict=True):
        for k in range(len(s) - r.LENGTH + 1):
            if 0 <= p - k < r.STARTS:
                assert int(a) >> k & 1 == int(b) >> k & 1


def test_nulls_and_empty_tables(spark):
    t = "".join(chr(97 + i % 26) for i in range(77)) + "0123456789" * 5
    rows = [(None, t), (1, None), (1, t), (1, t), (None, "")]
    got = sorted((x.doc_id is not None, x.doc_id, bytes(x.kept)) for x in r.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if x.doc_id or x.n_bytes)
    assert [g[2] for g in got] == [t.encode(), b"", b"", b""]
    assert r.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    docs = sorted((x.doc_id, (x.text or "").encode()) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = {d: (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()) for (d, raw), (kept, spans) in zip(docs, brute([x for _, x in docs]), strict=True)}
    got = {x[0]: tuple(x)[1:] for x in r.op3_suffix_dedup(spark, sf_dir).collect()}
    assert got == want and any(w[1] for w in want.values())
