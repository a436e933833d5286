"""Chat formatting into prefix trees.

Conversations that start with the same turns share those turns: each distinct prefix is one node, and a tree is all
nodes under one first turn. pack() lays every tree out depth-first, so that each shared turn is emitted once, and gives
every node its interval in the packed sequence of its tree, its position ids (which restart at its parent's end, as in
the conversation alone) and the intervals of its ancestors, which are all that its tokens may attend to beside
themselves. Tokens are code points of the formatted text.

Scale. Nodes are found by a partial aggregation on the prefix key (a chained digest of 16 bytes, whatever the depth), so
a first turn that a third of all conversations share is one row per task. A node's path is the keys at which its way from
the root branches off, laid end to end: in order of path and depth, nodes come depth-first, and turns that nothing
branches off from add nothing to it. Nodes are range-partitioned in this order and each partition adds up its own lengths.
The driver gets a row per partition (its length and its open ancestors, as many as a conversation is deep) to turn these
into offsets. No tree is ever held in one task.

Reading back. pages() cuts the packed sequences into pages of PAGE code points, each with its loss mask; read() looks up,
for every conversation, the intervals of its last turn and that turn's ancestors in these pages. Nothing but the packed
sequences, intervals, position ids and masks is used, and no task needs more than a page and a conversation.

Template. A turn is `<s>[INST] role [/INST]text</s>`. Where a text or role has one of the four control strings, a
backslash goes after its first character (and one more where there are some already), which unescape() takes out again.

Null text or role counts as empty; turns of equal number are ordered by role and text; null conv_id is a conversation
of its own; an empty table gives empty results; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: Java, Python and RE2 read this alike
CONTROL_PATTERN = r"(<|\[)(\\*)(/?s>|/?INST\])"
_control = re.compile(CONTROL_PATTERN)
_escaped = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\])")
_turn = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)


def escape(s: str) -> str:
    return _control.sub(lambda m: f"{m[1]}{m[2]}\\{m[3]}", s)


def unescape(s: str) -> str:
    return _escaped.sub(lambda m: m[1] + m[2] + m[3], s)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the interval of its loss mask: the text of an assistant, else nothing."""
    head = f"<s>[INST] {escape(role)} [/INST]"
    body = escape(text)
    stop = len(head) + len(body) if role == "assistant" else len(head)
    return f"{head}{body}</s>", len(head), stop


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a row per conversation, its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _prefixes(batches):
    """A row for each turn of each conversation; its key is a digest of all turns up to it."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parent, chain = None, hashlib.sha256()
            for depth, t in enumerate(row["turns"]):
                for part in (t["role"], t["text"]):
                    raw = part.encode()
                    chain.update(len(raw).to_bytes(8, "little") + raw)
                key = chain.digest()[:16]
                text, start, stop = format_turn(t["role"], t["text"])
                out.append((row["conv_id"], depth, key, parent, depth == len(row["turns"]) - 1, text, start, stop))
                parent = key
                if len(out) >= 4000:
                    yield _batch(out, _PREFIX)
                    out = []
        if out:
            yield _batch(out, _PREFIX)


def _paths(batches):
    """(key, path) of the rows (conv_id, depth, key, branch) of conversations, which come in order of depth."""
    path = b""
    for batch in batches:
        out = []
        for depth, key, branch in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
            path = key if depth == 0 else path + key if branch else path
            out.append((key, path))
        if out:
            yield _batch(out, {"key": pa.binary(), "path": pa.binary()})


_PREFIX = {"conv_id": pa.int64(), "depth": pa.int32(), "key": pa.binary(), "parent": pa.binary(), "last": pa.bool_(), "tokens": pa.string(), "loss_start": pa.int32(), "loss_stop": pa.int32()}
PREFIX = "conv_id long, depth int, key binary, parent binary, last boolean, tokens string, loss_start int, loss_stop int"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_LOCAL = {"pid": pa.int32(), "tree": pa.binary(), "key": pa.binary(), "depth": pa.int32(), "tokens": pa.string(), "loss_start": pa.int32(), "loss_stop": pa.int32(), "at": pa.int64(), "missing": pa.int32(), "above": _SPANS}
LOCAL = "pid int, tree binary, key binary, depth int, tokens string, loss_start int, loss_stop int, at long, missing int, above array<struct<start:long,stop:long>>"
_NODE = {"tree": pa.binary(), "key": pa.binary(), "depth": pa.int32(), "tokens": pa.string(), "start": pa.int64(), "stop": pa.int64(), "position": pa.int64(), "ancestors": _SPANS, "loss_start": pa.int64(), "loss_stop": pa.int64()}
NODE = "tree binary, key binary, depth int, tokens string, start long, stop long, position long, ancestors array<struct<start:long,stop:long>>, loss_start long, loss_stop long"


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _push(stack: list, start: int, stop: int) -> None:
    """Put an interval on the stack of open ancestors, with the index and the start of the run of neighbours that it is in."""
    last = stack[-1] if stack else None
    stack.append((start, stop, last[2], last[3]) if last and last[1] == start else (start, stop, len(stack), start))


def _merged(stack: list) -> list[dict]:
    """The intervals of the ancestors that are held, neighbours as one."""
    out, i = [], len(stack) - 1
    while i >= 0 and stack[i]:
        _, stop, first, start = stack[i]
        out.append({"start": start, "stop": stop})
        i = first - 1
    return out[::-1]


def _lay_out(batches):
    """Offsets within the partition, and the ancestors that it holds itself; the first `missing` ones of each path are in
    earlier partitions.

    The last row, without key, has the partition's length and the ancestors that are open at its end.
    """
    pid, at, stack = TaskContext.get().partitionId(), 0, []
    for batch in batches:
        out = []
        for r in batch.select(["path", "key", "depth", "tokens", "loss_start", "loss_stop"]).to_pylist():
            depth = r["depth"]
            if not stack:
                stack = [None] * depth
                missing = depth
            del stack[depth:]
            missing = min(missing, depth)
            n = len(r["tokens"])
            out.append((pid, r["path"][:16], r["key"], depth, r["tokens"], r["loss_start"], r["loss_stop"], at, missing, _merged(stack)))
            _push(stack, at, at + n)
            at += n
        if out:
            yield _batch(out, _LOCAL)
    if stack:
        yield _batch([(pid, None, None, None, None, None, None, at, missing, [{"start": x[0], "stop": x[1]} if x else None for x in stack])], _LOCAL)


def _place(starts):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                base, inherited = starts.value[r["pid"]]
                above = _merged(inherited[: r["missing"]]) + [{"start": x["start"] + base, "stop": x["stop"] + base} for x in r["above"]]
                at, n = r["at"] + base, len(r["tokens"])
                root = above[0]["start"] if above else at
                spans: list[dict] = []
                for x in above:  # what is inherited may end where the partition begins
                    if spans and spans[-1]["stop"] == x["start"] - root:
                        spans[-1]["stop"] = x["stop"] - root
                    else:
                        spans.append({"start": x["start"] - root, "stop": x["stop"] - root})
                start = at - root
                out.append((r["tree"], r["key"], r["depth"], r["tokens"], start, start + n, sum(x["stop"] - x["start"] for x in above), spans, start + r["loss_start"], start + r["loss_stop"]))
            if out:
                yield _batch(out, _NODE)

    return run


def pack(prefixes: DataFrame) -> DataFrame:
    """The nodes of all trees: tree (its first turn's key), key, depth, tokens, the interval [start, stop) and the first
    position id in the tree's packed sequence, ancestors (intervals to attend to, neighbours merged), and the interval
    of the loss mask."""
    spark = prefixes.sparkSession
    nodes = materialize(prefixes.groupBy("key").agg(*(F.first(c).alias(c) for c in ("depth", "parent", "tokens", "loss_start", "loss_stop"))))
    branches = nodes.where("parent IS NOT NULL").groupBy("parent").count().where("count > 1").select("parent", F.lit(True).alias("branch"))
    ways = prefixes.select("conv_id", "depth", "key", "parent").join(branches, "parent", "left").select("conv_id", "depth", "key", F.coalesce("branch", F.lit(False)).alias("branch"))
    ways = ways.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "depth").mapInArrow(lean(_paths), "key binary, path binary")
    nodes = nodes.join(ways.groupBy("key").agg(F.first("path").alias("path")), "key")
    local = materialize(nodes.repartitionByRange("path", "depth").sortWithinPartitions("path", "depth").mapInArrow(lean(_lay_out), LOCAL))
    starts, base, stack = {}, 0, []
    for r in sorted(local.where("key IS NULL").select("pid", "at", "above").collect(), key=lambda r: r.pid):
        starts[r.pid] = (base, stack)
        # what this partition inherits stays open as far as its last path goes through it
        held = [(x.start + base, x.stop + base) if x else stack[i][:2] for i, x in enumerate(r.above)]
        stack = []
        for x in held:
            _push(stack, *x)
        base += r["at"]
    held = spark.sparkContext.broadcast(starts)
    return local.where("key IS NOT NULL").mapInArrow(lean(_place(held)), NODE)


def trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, nodes) of conversations (conv_id, turn, role, text)."""
    prefixes = materialize(gather(conversations).mapInArrow(lean(_prefixes), PREFIX))
    return prefixes, pack(prefixes)


#: code points of a page
PAGE = 1024


def _cut(size: int):
    """(tree, page, at, tokens, mask): the nodes' tokens by page; of the mask, 0 or 1 for each code point is in the loss."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.select(["tree", "start", "stop", "tokens", "loss_start", "loss_stop"]).to_pylist():
                start, stop = r["start"], r["stop"]
                tokens = r["tokens"][: stop - start]
                mask = ("0" * (r["loss_start"] - start) + "1" * (r["loss_stop"] - r["loss_start"])).ljust(len(tokens), "0")
                while start < stop:
                    n = min(stop, (start // size + 1) * size) - start
                    out.append((r["tree"], start // size, start, tokens[:n], mask[:n]))
                    tokens, mask, start = tokens[n:], mask[n:], start + n
            if out:
                yield _batch(out, {"tree": pa.binary(), "page": pa.int64(), "at": pa.int64(), "tokens": pa.string(), "mask": pa.string()})

    return run


def pages(nodes: DataFrame) -> DataFrame:
    """(tree, page, tokens, mask): the packed sequences, PAGE code points to a page."""
    pieces = nodes.mapInArrow(lean(_cut(PAGE)), "tree binary, page long, at long, tokens string, mask string")
    held = pieces.groupBy("tree", "page").agg(F.sort_array(F.collect_list(F.struct("at", "tokens", "mask"))).alias("held"))  # at most PAGE pieces
    return held.select("tree", "page", *(F.array_join(F.col(f"held.{c}"), "").alias(c) for c in ("tokens", "mask")))


def read(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, chars, parts): what every conversation's last turn and its ancestors have in the packed sequences, as
    array of (at, tokens, mask), and the number of code points that its position ids tell."""
    last = prefixes.where("last").select("conv_id", "key").join(nodes.select("key", "tree", "start", "stop", "position", "ancestors"), "key")
    spans = F.concat("ancestors", F.array(F.struct("start", "stop")))
    spans = last.select("conv_id", "tree", (F.col("position") + F.col("stop") - F.col("start")).alias("chars"), F.explode(spans).alias("span"))
    wanted = spans.select("conv_id", "tree", "chars", "span.*").withColumn("page", F.explode(F.expr(f"sequence(start div {PAGE}, (stop - 1) div {PAGE})")))
    at = f"greatest(start, page * {PAGE})"
    part = [F.expr(f"substring({c}, int({at} - page * {PAGE}) + 1, int(least(stop, (page + 1) * {PAGE}) - {at}))").alias(c) for c in ("tokens", "mask")]
    found = wanted.join(pages(nodes), ["tree", "page"]).select("conv_id", "chars", F.struct(F.expr(at).alias("at"), *part).alias("part"))
    return found.groupBy("conv_id", "chars").agg(F.collect_list("part").alias("parts"))


def _digests(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["at"])
            whole, mask = ("".join(p[c] for p in parts) for c in ("tokens", "mask"))
            turns = read_back(whole)
            # escapes don't reach across turns
            loss = "".join(unescape(whole[m.start() : m.end()]) for m in re.finditer("1+", mask))
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((r["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), r["chars"]))
        if out:
            yield _batch(out, _DIGEST)


_DIGEST = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_prefix_tree(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one that is made of control strings, read back from the packed trees."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    prefixes, nodes = trees(rows.unionByName(extra))
    return read(prefixes, materialize(nodes)).mapInArrow(lean(_digests), DIGEST)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length('<s>[INST]  [/INST]</s>')
    + length(regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
