import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import orderminhash as o


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_band_against_brute_force(a, b, limit):
    d = distance(a, b)
    assert o.within(list(a), list(b), limit) == (d if d <= limit else None)


def test_sketches_keep_text_order():
    words = [f"w{i}" for i in range(60)]
    other = words[30:] + words[:30]  # the same k-mers but for a few, in another order
    a, b, c = o.sketches([" ".join(w).encode() for w in (words, other, [*words[:59], "x"])])
    assert 0.2 < (a == b).mean() < 0.8 < (a == c).mean()
    a, b = o.sketches([b"a b c d e " * 30, b"A\tb c d e\n" * 30])
    assert (a == b).all()
    assert not o.sketches([b"", b" \n"]).any()


def test_classes_against_brute_force(spark):
    rng = random.Random(7)
    rows, texts = [], []
    for _ in range(60):
        words = [f"{rng.randint(0, 400)}" for _ in range(rng.choice([80, 150, 300]))]
        texts.append(words)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            texts.append([w if rng.random() > 0.04 else "new" for w in words if rng.random() > 0.02])
    texts += [texts[5]] * 40 + [[]] * 3 + [["a", "b"]] * 2
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)] + [(None, " ".join(texts[5]), "x"), (900, None, "x"), (5, " ".join(texts[5]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c string").repartition(5)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if o.similar(texts[i], texts[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = o.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.class_id == root(r.doc_id)
    assert [r.class_id for r in got if r.doc_id is None] == [root(5)]
    assert [r.class_id for r in got if r.doc_id == 900] == [texts.index([])]


@pytest.mark.parametrize("most", [64, 5])
def test_one_bucket_of_different_texts_keeps_all_links(spark, monkeypatch, most):
    # one sketch value for all: those that are no link to the leader must find each other
    import pyarrow as pa

    size = 8 * o.SKETCHES

    def constant(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bytes([1] * size)] * b.num_rows, pa.binary())], names=["doc_id", "c", "sketch"])

    monkeypatch.setattr(o, "_sketch", constant)
    monkeypatch.setattr(o, "MOST_TOGETHER", most)
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = [f"{g}_{rng.randint(0, 99)}" for _ in range(40)]
        rows += [(100 * g + k, " ".join([*words[: 39 - k], "x"])) for k in range(3)]
    got = o.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: d // 100 * 100 for d, _ in rows}


def test_empty_table(spark):
    assert o.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def classes_by_buckets(texts):
    """The least text of each one's class, by all pairs that share a sketch and are alike."""
    sk = o.sketches([" ".join(t).encode() for t in texts])
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in ((sk[:i] == sk[i]).any(axis=1)).nonzero()[0].tolist():
            if root(i) != root(j) and o.similar(texts[i], texts[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_shared_passage_over_more_texts_than_meet_at_once(spark, monkeypatch):
    # many texts share a passage; of an edited copy and its original, some share sketches of the passage only
    monkeypatch.setattr(o, "MOST_TOGETHER", 20)
    rng = random.Random(9)
    passage, texts = [f"p{i}" for i in range(20)], []
    for g in range(120):
        own = [f"w{g}x{i}" for i in range(60)]
        texts += [[*own[:30], *passage, *own[30:]]]
        at = sorted(range(60), key=lambda i: (i % 4 != g % 4, rng.random()))[:14]
        own = [f"e{g}x{i}" if i in at else w for i, w in enumerate(own)]
        texts += [[*own[:30], *passage, *own[30:]]]
    want = classes_by_buckets(texts)
    assert len(set(want)) < 200
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in o.near_duplicates(docs).collect()} == dict(enumerate(want))


def test_near_copies_that_differ_by_about_the_limit(spark):
    # many are no link to a leader, but to texts that are
    rng = random.Random(10)
    texts = []
    for g in range(2):
        words = [f"w{g}x{i}" for i in range(100)]
        texts += [[w if rng.random() > 0.12 else f"e{rng.randint(0, 99999)}" for w in words] for _ in range(220)]
    want = classes_by_buckets(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in o.near_duplicates(docs).collect()} == dict(enumerate(want))


def test_query_against_all_pairs(spark, sf_dir):
    """Every pair of documents that is alike by brute force is in one class, and no class holds more than these links."""
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = len(texts[a]), len(texts[b])
            if min(x, y) >= 0.8 * max(x, y) and o.similar(texts[a], texts[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.class_id for r in o.op4_order_minhash(spark, sf_dir).collect()}
    assert got == {d: root(d) for d in ids}


def test_keys_of_large_groups_meet():
    import numpy as np
    import pyarrow as pa
    import zstandard

    rng = random.Random(11)
    frequency = np.array([rng.choice([1, 5, 1000]) for _ in range(o.LONGEST << o.FREQUENCY_BITS)])
    tried = 0
    for size in [*range(1, 40), 60, 100]:
        for _ in range(25):
            a = [f"{rng.randint(0, 6 if size % 3 else 5000)}" for _ in range(size)]
            b = list(a)
            for _ in range(rng.randint(0, int(0.2 * size))):
                i, kind = rng.randrange(len(b)), rng.random()
                b[i : i + (kind < 0.7)] = [f"e{rng.randint(0, 9)}"] if kind < 0.4 or kind >= 0.7 else []
            if b and o.similar(a, b):
                tried += 1
                texts = pa.array([zstandard.compress(" ".join(t).encode()) for t in (a, b)], pa.binary())
                ((_, levels),) = o._coded([pa.RecordBatch.from_arrays([texts], names=["body"])], "body", o.LONGEST)
                assert len(np.intersect1d(*o._keys_of_all(levels, frequency))), (a, b)
    assert tried > 700


def test_groups_of_any_number_of_parts(monkeypatch):
    import zstandard

    monkeypatch.setattr(o, "MOST_WORDS", 300)
    rng = random.Random(12)
    group, texts = o.Group(0), []
    for g in range(12):
        words = [f"{g}_{rng.randint(0, 99)}" for _ in range(40)]
        texts += [[*words[: 39 - k], "x"] for k in range(3)]
    for i, t in enumerate(texts):
        raw = " ".join(t).encode()
        codes = o.numbered(o.Words([raw], lower=True).hash, o.np.zeros(len(t), o.np.int64))
        group.add(i, zstandard.compress(raw), codes, None)
    forest = o.Forest()
    for a, b in group.links():
        forest.join(a, b)
    assert [forest.root(i) for i in range(36)] == [i // 3 * 3 for i in range(36)]
