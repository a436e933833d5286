import math
import random
import zlib

import pytest

from tallyspark.llm import langid


def grams(text):
    raw = text.lower().encode()
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_presence_is_exact_and_stays_inside_texts():
    rng = random.Random(1)
    texts = ["", "a", "ab", "é", "Ab aB"] + ["".join(rng.choice("abé 漢") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    codes, first = langid.presence(texts)
    for i, t in enumerate(texts):
        got = {int(c & 0xFFFFFF).to_bytes(int(c >> 24), "big") for c in codes[first[i] : first[i + 1]]}
        assert got == grams(t) and first[i + 1] - first[i] == len(got)


def test_folded_scores_equal_the_kernel_sum():
    rng = random.Random(2)
    rows = [(lang, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(20))) for lang, a in (("x", "abcd"), ("y", "cdef"), ("z", "efgh")) for _ in range(30)]
    model = langid.solve(rows, landmarks=9)
    text = rows[5][1] + " zzz"
    lang, score = langid.predict(model, [text])
    assert lang == ["x"] and 0.5 < score[0] <= 1
    mine = grams(text)
    weights = {int(c): w for c, w in zip(model.grams, model.weights[:-1], strict=True)}
    code = lambda g: len(g) << 24 | int.from_bytes(g, "big")
    total = sum(weights[code(g)][0] for g in mine if code(g) in weights) / math.sqrt(len(mine)) + model.bias[0]
    assert min(1, (total + 1) / 2) == pytest.approx(score[0], abs=1e-5)


def test_held_out_accuracy_and_contract(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op9_langid(spark, sf_dir).collect()
    assert len(got) == len(truth)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == truth[r.doc_id].lang)
    assert sum(right) / len(right) > 0.9


def test_model_does_not_depend_on_partitions_or_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(w) for _ in range(15)), lang) for i in range(300) for lang, w in [rng.choice([("en", ["the", "and", "ing"]), ("de", ["der", "und", "ung"])])]]
    rows += [(None, "x", "en"), (1, None, "de"), (2, "123 !!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = langid.fit(docs.repartition(7), per_language=20), langid.fit(docs.coalesce(1), per_language=20)
    assert (a.grams == b.grams).all() and (a.weights == b.weights).all()
    out = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, a).collect()}
    assert {(2, "und"), (1, "und")} <= out


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(none) is None and langid.identify(none, None).collect() == []
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(one, langid.fit(one)).collect()] == [(1, "und", 0.0)]


def test_against_plain_kernel_ridge_regression():
    # with every row a landmark, the Nystroem map is the kernel itself: compare with the dual system, solved for sets
    import numpy as np

    rng = random.Random(4)
    vocab = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(30)] for k, letters in (("x", "abcdef"), ("y", "defghi"), ("z", "aeiouß"))}
    prose = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    rows = [(k, prose(k, rng.randint(3, 20))) for k, n in (("x", 9), ("y", 5), ("z", 7)) for _ in range(n)]

    def grams(text):
        raw = text.lower().encode()
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    sets = [grams(t) for _, t in rows]
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    languages = ["x", "y", "z"]
    goal = np.array([[1.0 if lang == own else -1.0 for lang in languages] for own, _ in rows])
    weight = np.array([1 / sum(o == own for o, _ in rows) for own, _ in rows])
    n = len(rows)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n] = k + langid.RIDGE * np.diag(1 / weight)
    system[:n, n] = system[n, :n] = 1
    solved = np.linalg.solve(system, np.vstack([goal, np.zeros((1, 3))]))
    texts = [prose(k, 8) for k in "xyzxyz"] + [prose("x", 4) + " " + prose("y", 5)]
    want = np.array([[kernel(grams(t), s) for s in sets] for t in texts]) @ solved[:n] + solved[n]
    model = langid.solve(rows, landmarks=3 * n)
    lang, score = langid.predict(model, texts)
    assert lang == [languages[i] for i in want.argmax(axis=1)]
    assert np.allclose(score, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)


def test_null_and_repeated_ids_stay_within_the_bound(spark):
    rows = [(None, f"abc {i} def", "x") for i in range(300)] + [(7, f"ghi {i} jkl", "y") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    held = []
    solve, langid.solve = langid.solve, lambda rows, landmarks: held.append(rows)
    try:
        langid.fit(docs, per_language=20)
    finally:
        langid.solve = solve
    assert len(held[0]) == 40
