import random
import re

import numpy as np

from tallyspark.llm import decontam


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row = new
        best = max(best, *row)
    return best


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_align_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64)
        sides = [rng.integers(1, 6, rng.integers(0, 20)).astype(np.uint64) for _ in range(3)]
        for side, (score, a, b) in zip(sides, decontam.align(item, sides), strict=True):
            assert score == smith_waterman(item.tolist(), side.tolist())
            assert smith_waterman(item.tolist(), side[a:b].tolist()) == score


def test_edited_copies_and_only_they(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocab) if rng.random() < 0.7 else rng.choice(["the", "of", "and"]) for _ in range(n)]
    items = [prose(40) for _ in range(30)] + [["the", "of"], []]
    rows, want = [], set()
    for d in range(600):
        body = prose(rng.randint(0, 300))
        if d % 3 == 0:  # a third of all documents hold a copy, most of item 0
            i = 0 if d % 2 == 0 else rng.randrange(30)
            copy = [rng.choice(vocab) if rng.random() < 0.15 else w for w in items[i] if rng.random() > 0.05]
            at = rng.randint(0, len(body))
            body = body[:at] + copy + body[at:]
            want.add((d, i))
        rows.append((d, " ".join(w.upper() + "," if rng.random() < 0.1 else w for w in body), "x"))
    rows += [(1000, None, "x"), (1001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    brute = {}
    for d, t, _ in rows:
        for i, item in enumerate(items):
            if len(item) >= 3 and (s := smith_waterman(item, words(t))) and decontam.passes(s, len(item)):
                brute[d, i] = s
    assert {k: r.score for k, r in got.items()} == brute
    assert set(brute) == want
    for (d, i), r in got.items():
        assert smith_waterman(items[i], words(rows[d][1])[r.start_word : r.stop_word]) == r.score
    assert decontam.clean(docs, bench).count() == len(rows) - len({d for d, _ in want})


def test_empty_tables_and_blocks_of_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "one two three four five six seven eight nine " + "x " * i) for i in range(6)], "item_id long, text string")
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    monkeypatch.setattr(decontam, "BLOCK_ITEM_WORDS", 30)
    assert sorted(r.item_id for r in decontam.leaks(docs, bench).collect()) == list(range(6))


def test_query_finds_the_planted_passages(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in decontam.op5_decontaminate(spark, sf_dir).collect()}
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for d, w in docs:
        have = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        for i, item in items:
            if any(tuple(item[k : k + 3]) in have for k in range(len(item) - 2)) and decontam.passes(smith_waterman(item, w), len(item)):
                want.add((d, i))
    assert got == want and got


def test_single_edited_and_half_copies_against_brute_force(spark):
    # items whose words no other document has, one copy of each: most of their word pairs occur nowhere
    rng = random.Random(11)
    items, rows, n = [], [], 0
    for k in range(240):
        item = [f"w{n + j}" for j in range(rng.choice([9, 15, 16, 27, 38, 50, 59]))]
        n += len(item)
        copy = list(item)
        if k % 4 < 2:  # edits of any kind
            copy, share = [], rng.uniform(0.15, 0.4)
            for j, w in enumerate(item):
                e = rng.random() / share
                copy += [w] if e > 1 else [f"e{k}x{j}"] if e > 0.4 else [f"e{k}x{j}", w] if e > 0.2 else []
        elif k % 4 == 2:  # half an item, a little edited
            copy = [w if rng.random() > 0.03 else f"e{k}x{j}" for j, w in enumerate(item[: len(item) // 2 + rng.randint(0, 4)])]
        elif k % 8 == 3:  # no three words in a row
            copy = [w if j % 3 else f"e{k}x{j}" for j, w in enumerate(item)]
        else:  # no two words in a row
            copy = [x for j, w in enumerate(item) for x in (w, f"e{k}x{j}")][:-1]
        pad = lambda: [f"p{rng.randint(0, 9)}" for _ in range(rng.randint(0, 90))]
        items.append(item)
        rows.append((k, " ".join(pad() + copy + pad())))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    scores = [smith_waterman(item, t.split()) for item, (_, t) in zip(items, rows, strict=True)]
    want = {(k, k): s for k, s in enumerate(scores) if decontam.passes(s, len(items[k]))}
    assert len(want) > 120
    assert {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench).collect()} == want


def test_clean_tells_rows_apart_by_null_safe_id_and_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(None, f"x {item} y"), (None, "clean"), (1, item), (1, "clean too"), (2, "clean"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = [tuple(r) for r in decontam.clean(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([rows[1], *rows[3:]], key=str)
