import random
import re
from collections import Counter

import pytest

from tallyspark.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_base_counts_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 30, "\x0b\x0ca b\x85 é漢🙂|", "w" * 100_000]
    texts += ["".join(rng.choice(["a", "b", "é", "#"]) + rng.choice([" ", "\n", "\t ", ""]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, None, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string, _words string")
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert (r.base_failed, r.kept, r._words) == (failed, not failed, "y")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "a", "in"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_divergence_rejects_shouting_and_lists_and_spares_prose(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 120), "en") for i in range(200)]
    rows += [(1000, prose(rng, 120).upper().replace(" ", "!! "), "en"), (1001, " | ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)), None)]
    rows += [(1002, prose(rng, 30).upper(), "xx")]  # too short to judge by its histograms
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [d for d, r in got.items() if not r.kept] == [1000, 1001]
    assert got[0].char_distance < 0.1 and got[1000].char_distance > 0.6 and got[1001].word_distance > quality.WORD_DISTANCE


def test_common_words_are_exact_when_bins_collide(spark, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 128)
    rng = random.Random(3)
    rows = [(i, prose(rng, 200) + " Is it so", rng.choice(["en", "de"])) for i in range(100)]
    refs = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for lang, words, shares, _ in refs:
        count = Counter(w for _, t, k in rows if k == lang for w in t.lower().split())
        want = sorted((-n, w) for w, n in count.items())[: quality.COMMON_WORDS]
        assert words == [w for _, w in want]
        assert shares[:-1] == pytest.approx([-n / count.total() for n, _ in want])


def test_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_query_against_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = db.execute(quality.ORACLE).fetchall()
    got = quality.op1_quality(spark, sf_dir)
    assert "Python" not in got._jdf.queryExecution().toString() and "InMap" not in got._jdf.queryExecution().toString()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_accepted_keeps_all_columns(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 120) if i % 2 else "x", "en", "mine", i, "dot") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words int, `a.b` string")
    out = quality.accepted(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 40, 2)) and {(r.kept, r["a.b"]) for r in got} == {("mine", "dot")} and all(r.n_words == r.doc_id for r in got)


def test_distances_against_plain_python(spark):
    from math import log2, sqrt

    rng = random.Random(8)
    refs = [("a", ["the", "of", "in"], [0.2, 0.1, 0.05, 0.65], [0.7, 0.05, 0.05, 0.1, 0.05, 0.03, 0.02]), ("b", ["und", "in"], [0.3, 0.1, 0.6], [0.6, 0.1, 0.05, 0.15, 0.05, 0.03, 0.02])]
    texts = [" ".join(rng.choice(["the", "OF", "in", "und", "xyz", "Q7."]) for _ in range(n)) for n in (1, 3, 50, 200)] + [""]

    def distance(p, q):
        half = lambda a, b: a * log2(2 * a / (a + b)) if a > 0 else 0.0
        return sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q, strict=True)) / 2))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", quality.F.lit("a"))
    for r in quality.quality_rules(docs, refs=refs).collect():
        words = texts[r.doc_id].lower().split()
        own = []
        for _, names, shares, _ in refs:
            p = [words.count(w) / max(len(words), 1) for w in names]
            own.append(distance([*p, 1 - sum(p)], shares))
        assert r.word_distance == pytest.approx(min(own), abs=1e-9)
