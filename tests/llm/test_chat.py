import random

from hypothesis import given
from hypothesis import strategies as st

from tallyspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, tokens string"


@given(st.text(alphabet="<>/s[]INST\\ a", max_size=40), st.text(alphabet="<s>\\[/INST] u", max_size=12))
def test_escape_is_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.read_back(chat.format_turn(role, text)[0]) == [(role, text)]


def brute(convs):
    """Node intervals by a plain depth-first walk in key order."""
    return {c: "".join(chat.format_turn(r, t)[0] for r, t in turns) for c, turns in convs.items()}


def test_trees_share_prefixes_and_give_back_every_conversation(spark):
    rng = random.Random(3)
    convs = {}
    for c in range(400):
        turns = [("user", "hi" if rng.random() < 0.5 else f"q{rng.randint(0, 5)}")]
        while rng.random() < 0.75:
            turns.append((rng.choice(["user", "assistant"]), rng.choice(["a", "b", "</s>", "é漢", "", "[INST] x [/INST]"])))
        convs[c] = turns
    rows = [(c, i, r, t, "clash") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    prefixes, nodes = chat.trees(spark.createDataFrame(rows, SCHEMA).repartition(5))
    nodes = nodes.collect()
    by_key = {bytes(n.key): n for n in nodes}
    assert len(by_key) == len(nodes) == len({tuple(t[: i + 1]) for t in convs.values() for i in range(len(t))})
    packed = {}
    for n in sorted(nodes, key=lambda n: (bytes(n.tree), n.start)):  # each tree's sequence has no gap and no overlap
        held = packed.get(bytes(n.tree), "")
        assert n.start == len(held) and n.stop - n.start == len(n.tokens)
        packed[bytes(n.tree)] = held + n.tokens
    want = brute(convs)
    leaf = {}
    for p in prefixes.collect():
        if p.last:
            leaf[p.conv_id] = bytes(p.key)
    for c, key in leaf.items():
        n = by_key[key]
        seq = packed[bytes(n.tree)]
        before = "".join(seq[a.start : a.stop] for a in n.ancestors)
        assert before + seq[n.start : n.stop] == want[c]
        assert n.position == len(before)
        assert all(a.stop < b.start for a, b in zip(n.ancestors, n.ancestors[1:], strict=False))
        assert seq[n.loss_start : n.loss_stop] == (chat.escape(convs[c][-1][1]) if convs[c][-1][0] == "assistant" else "")


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, 0, "user", None, ""), (1, 0, None, "x", ""), (1, 0, "user", "x", ""), (1, None, "assistant", "y", ""), (1, 0, "user", "x", "")]
    prefixes, nodes = chat.trees(spark.createDataFrame(rows, SCHEMA))
    assert prefixes.count() == 5 and nodes.count() == 5
    prefixes, nodes = chat.trees(spark.createDataFrame([], SCHEMA))
    assert prefixes.count() == nodes.count() == 0


def test_query_against_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = db.execute(chat.ORACLE).fetchall()
    got = [tuple(r) for r in chat.op6_prefix_tree(spark, sf_dir).collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, got))
    assert {r[0] for r in got} >= {-7}


def digests(prefixes, nodes):
    return {r.conv_id: r[1:] for r in chat.read(prefixes, nodes).mapInArrow(chat._digests, chat.DIGEST).collect()}


def test_result_is_read_from_the_packed_layout(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(chat, "PAGE", 16)
    rows = [(c, i, "assistant" if i % 2 else "user", t, "") for c, turns in enumerate(["ab", "acd", "ace", "b", "acdfgh"]) for i, t in enumerate(turns)]
    prefixes, nodes = chat.trees(spark.createDataFrame(rows, SCHEMA))
    nodes = chat.materialize(nodes)
    want = digests(prefixes, nodes)
    assert {c: (w[0], w[4]) for c, w in want.items()} == {c: (n, n * len("<s>[INST]  [/INST]x</s>") + (n + 1) // 2 * 4 + n // 2 * 9) for c, n in enumerate([2, 3, 3, 1, 6])}
    for column, wrong in (("start", F.col("start") + 1), ("stop", F.col("stop") - 1), ("position", F.lit(-5)), ("ancestors", F.expr("slice(ancestors, 1, 0)")), ("loss_start", F.col("loss_start") + 1), ("ancestors", F.transform("ancestors", lambda x: F.struct((x.start + 1).alias("start"), x.stop.alias("stop"))))):
        assert digests(prefixes, nodes.withColumn(column, wrong)) != want, column


def test_a_deep_conversation_costs_little(spark):
    rows = [(c, i, "user", "x" if i < 1990 else f"{c}", "") for c in range(3) for i in range(2000)]
    prefixes, nodes = chat.trees(spark.createDataFrame(rows, SCHEMA).repartition(3))
    nodes = nodes.collect()
    assert len(nodes) == 1990 + 3 * 10
    assert sum(len(n.key) + len(n.tree) + 16 * len(n.ancestors) for n in nodes) < 200_000
