"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

What goes: every byte covered by a LENGTH-byte string that also starts earlier (in a document of smaller id, or earlier
in the same one). All strings are judged on the input.

1. Every LENGTH-byte window names one SEED-byte string in it, the one of least hash (leftmost of equals). Equal windows
   name equal seeds at equal places, so windows are compared only within a seed. Windows in a row that name the same
   occurrence of a seed form a segment of at most 51 starts. Seeds that occur once in the corpus are dropped: counts by
   hash bucket, then a Bloom filter of fixed size, so what it wrongly passes costs time only.
2. Per block, equal segments of a seed count once. Buckets of seeds find the first occurrence of every distinct segment;
   all starts of the others are repeats. Seeds with several distinct segments need the bytes.
3. These segments meet by seed, in order of occurrence, and are indexed: their BWT in runs, with the text positions of
   the run ends sampled and the match length at every run start. Streaming the positions between two samples gives each
   one's neighbour in suffix order and its match length (one less per step); matches of LENGTH or more join positions to
   classes, and all but the first of a class are repeats.
4. Every block covers its own bytes from these answers.

A seed's rows are at most one per distinct segment and block, and an index holds at most INDEX_BYTES; larger groups are
split by the bytes that a range of starts has in common, down to single windows, which is exact. Blocks of documents
pass between stages packed; texts never meet other texts.

Null text counts as empty; null ids come first; rows of one id (also repeated rows) are documents of their own, in the
order in which they are read. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, U64, Bloom, Rolling, blocks, bloom_words, input_bytes, lean, materialize, mix, pack, packed_keys, shared_keys, texts, unpack

LENGTH, SEED = 100, 50
STARTS = LENGTH - SEED + 1
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 32 << 20
INDEX_BYTES = 2 << 20
HEAD, ENTRY, MASK = 0, 1, 2
PARTS = "kind int, block long, bucket int, doc_ids array<long>, lens array<int>, body binary"
_PARTS = {"kind": pa.int32(), "block": pa.int64(), "bucket": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lens": pa.list_(pa.int32()), "body": pa.binary()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTS.values(), strict=True)], names=list(_PARTS))


# ---- seeds and segments ----------------------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Segments:
    """The segments of a block: seed hash, first start a, last start b, place of the seed, text number, in text order."""

    def __init__(self, data: np.ndarray, lens: np.ndarray):
        self.data = data
        self.first = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        none = np.zeros(0, np.int64)
        if len(data) < LENGTH:
            self.seed, self.a, self.b, self.at, self.doc, self.rolling = none.astype(U64), none, none, none, none, None
            return
        self.rolling = Rolling(data)
        r, n = self.rolling, len(data) - SEED + 1
        h = mix((r.prefix[SEED:] - r.prefix[:n]) * r.down[:n])
        low = sliding_min(((h >> U64(32)) << U64(32)) | np.arange(n, dtype=U64), STARTS)
        named = (low & U64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(len(named), dtype=bool)
        for i in np.flatnonzero(lens >= LENGTH):
            inside[self.first[i] : self.first[i + 1] - LENGTH + 1] = True
        change = np.concatenate([[True], (named[1:] != named[:-1]) | ~inside[:-1]])
        self.a = np.flatnonzero(change & inside)
        ends = np.concatenate([np.flatnonzero(change), [len(named)]])
        self.b = ends[np.searchsorted(ends, self.a, "right")] - 1
        # a run may end where a text ends
        over = ~inside[self.b]
        if over.any():
            stops = np.flatnonzero(inside[:-1] & ~inside[1:])
            self.b[over] = stops[np.searchsorted(stops, self.a[over])]
        self.at = named[self.a]
        self.seed = h[self.at]
        self.doc = np.searchsorted(self.first, self.a, "right") - 1

    def keep(self, which: np.ndarray) -> None:
        self.seed, self.a, self.b, self.at, self.doc = (x[which] for x in (self.seed, self.a, self.b, self.at, self.doc))

    def content(self) -> np.ndarray:
        """64 bits that, with the 64 of the seed, stand for a segment's bytes and the seed's place in it."""
        if not len(self.a):
            return np.zeros(0, U64)
        h = self.rolling.hash(self.a, self.b + LENGTH)
        return mix(h + (self.at - self.a).astype(U64) * U64(0x9E3779B97F4A7C15) + (self.b - self.a).astype(U64))


def ordered(ids: list) -> np.ndarray:
    """Ids as unsigned numbers of the same order, null first."""
    return np.array([0 if i is None else i + (1 << 63) for i in ids], dtype=U64)


class Entries:
    """Distinct (seed, content) of a block's shared segments, sorted by bucket and seed, with the first occurrence."""

    def __init__(self, seg: Segments, doc_keys: np.ndarray, buckets: int):
        g = seg.content()
        key = doc_keys[seg.doc] if len(seg.doc) else np.zeros(0, U64)
        bucket = (seg.seed % U64(buckets)).astype(np.int32)
        order = np.lexsort((seg.a, seg.doc, key, g, seg.seed, bucket))
        s, gg = seg.seed[order], g[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (gg[1:] != gg[:-1])]) if len(s) else np.zeros(0, bool)
        self.of = np.empty(len(order), np.int64)  # the entry of each segment
        self.of[order] = np.cumsum(new) - 1
        self.lead = order[new]  # the segment that is first
        self.seed, self.content, self.key, self.bucket = s[new], gg[new], key[order][new], bucket[order][new]
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))


# ---- the index -------------------------------------------------------------------------------------------------------


class RunLengthIndex:
    """The BWT of segments in runs, with the ends of the runs sampled.

    Symbols are bytes + 1; 0 closes a segment, and closers stand in text order, so suffixes differ within their segment.
    Kept of each run: its symbol, its length, the text position at its start (head) and at the end of the run before
    (its neighbour in suffix order), and how far the two match.
    """

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        before = np.concatenate([symbols[-1:], symbols[:-1]])[order]
        # closers are all different, so each of them is a run of its own
        starts = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)]))
        self.n = len(symbols)
        self.symbol = before[starts]
        self.length = np.diff(np.concatenate([starts, [self.n]]))
        head = order[starts]
        self.tail = order[np.concatenate([starts[1:] - 1, [self.n - 1]])]
        by_text = np.argsort(head)
        self.head = head[by_text]
        self.neighbour = np.concatenate([[-1], self.tail[:-1]])[by_text]
        self.match = matches(symbols, self.head, self.neighbour)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """(neighbour, match length) of every text position: each sample serves up to the next one."""
        at = np.arange(self.n)
        sample = np.searchsorted(self.head, at, "right") - 1
        step = at - self.head[sample]
        return self.neighbour[sample] + step, self.match[sample] - step

    def repeats(self, length: int) -> np.ndarray:
        """Positions whose next `length` symbols also start earlier in the text."""
        neighbour, match = self.stream()
        up = np.where((match >= length) & (neighbour >= 0), neighbour, np.arange(self.n))
        while True:  # to the top of each class
            far = up[up]
            if (far == up).all():
                break
            up = far
        first = np.full(self.n, self.n)
        np.minimum.at(first, up, np.arange(self.n))
        return first[up] < np.arange(self.n)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Text positions by suffix, each up to its closer, then by position; ranks by 7 symbols, then by prefix doubling."""
    n = len(symbols)
    stop = np.flatnonzero(symbols == 0)
    end = stop[np.searchsorted(stop, np.arange(n))]  # the closer of each position
    key = np.zeros(n, dtype=U64)
    wide = np.concatenate([symbols.astype(U64), np.zeros(7, U64)])
    alive = np.ones(n, dtype=bool)
    for k in range(7):
        key = (key << U64(9)) | np.where(alive, wide[k : k + n], U64(0))
        alive &= np.arange(n) + k < end
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    h = 7
    while True:
        size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that are not settled
        p = order[open_]
        if not len(p) or h > LENGTH + STARTS:
            return order
        nxt = np.where(p + h <= end[p], rank[np.minimum(p + h, n - 1)] + 1, 0)
        sub = np.argsort((rank[p].astype(U64) << U64(32)) | nxt.astype(U64), kind="stable")
        p, nxt = p[sub], nxt[sub]
        order[open_] = p
        own = rank[p]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        new[open_] = fresh
        rank[p] = np.maximum.accumulate(np.where(fresh, open_, 0))
        h *= 2


def matches(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a and from b on are equal, up to a closer; 0 where b is negative."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(b >= 0)
    wide = np.concatenate([symbols, np.zeros(1, symbols.dtype)])
    k = 0
    while len(live):
        x, y = wide[np.minimum(a[live] + k, len(symbols))], wide[np.minimum(b[live] + k, len(symbols))]
        live = live[(x == y) & (x != 0)]
        k += 1
        out[live] = k
    return out


def masks_of(segs: list[bytes]) -> np.ndarray:
    """For segments in order of occurrence, a bit for each start (the first lowest) that an earlier one also has."""
    parts = [np.concatenate([np.frombuffer(s, np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16)]) for s in segs]
    symbols = np.concatenate(parts)
    again = RunLengthIndex(symbols).repeats(LENGTH)
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    out = np.zeros(len(segs), dtype=U64)
    for k in range(STARTS):
        own = sizes - 1 - LENGTH >= k
        out[own] |= again[first[own] + k].astype(U64) << U64(k)
    return out


def group_masks(segs: list[bytes], place: list[int], width: int = STARTS) -> np.ndarray:
    """masks_of for one seed's segments, whose seed begins at place; a group that is too large for one index is split by
    what a range of starts has in common, which equal windows share."""
    if sum(map(len, segs)) <= INDEX_BYTES:
        return masks_of(segs)
    out = np.zeros(len(segs), dtype=U64)
    width = 10 if width > 10 else 1
    parts: dict[tuple, list] = {}
    for i, (s, p) in enumerate(zip(segs, place, strict=True)):
        for t in range(0, STARTS, width):  # starts that lie t to t + width - 1 before the seed
            lo, hi = max(0, p - t - width + 1), min(p - t, len(s) - LENGTH)
            if lo <= hi:
                core = s[p - t : p - t + LENGTH - width + 1] if width > 1 else s[lo : lo + LENGTH]
                parts.setdefault((t, hashlib.blake2b(core, digest_size=16).digest()), []).append((i, lo, hi))
    for (t, _), own in parts.items():
        if width == 1:  # all windows are equal: all but the first are repeats
            for i, lo, _ in own[1:]:
                out[i] |= U64(1) << U64(lo)
            continue
        got = group_masks([segs[i][lo : hi + LENGTH] for i, lo, hi in own], [place[i] - lo for i, lo, _ in own], width)
        for (i, lo, _), m in zip(own, got, strict=True):
            out[i] |= m << U64(lo)
    return out


# ---- stages ----------------------------------------------------------------------------------------------------------


def _seeds(buckets: int):
    def run(batches):
        for block in blocks(batches, "text", BLOCK_BYTES):
            raw = [t.encode() for t in texts(block, "text")]
            yield from packed_keys(Segments(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])).seed, buckets)

    return run


def block_entries(data: np.ndarray, lens: np.ndarray, ids: list, bloom: Bloom, buckets: int) -> tuple[Segments, Entries]:
    seg = Segments(data, lens)
    seg.keep(bloom.passes(seg.seed))
    return seg, Entries(seg, ordered(ids), buckets)


def _cut(held, buckets: int):
    def run(batches):
        bloom, number = Bloom(held.value), 0
        for block in blocks(batches, "text", BLOCK_BYTES):
            key = (TaskContext.get().partitionId() << 32) + number
            number += 1
            raw = [t.encode() for t in texts(block, "text")]
            lens, ids = [len(r) for r in raw], block.column(0).to_pylist()
            whole = b"".join(raw)
            yield _rows([(HEAD, key, -1, ids, lens, zstandard.compress(whole, 3))])
            seg, e = block_entries(np.frombuffer(whole, np.uint8), np.array(lens), ids, bloom, buckets)
            rows = []
            for b in range(buckets):
                own = slice(e.cuts[b], e.cuts[b + 1])
                lead = e.lead[own]
                if len(lead):
                    rows.append((ENTRY, key, b, None, None, pack(np.diff(e.seed[own], prepend=U64(0)), e.content[own], e.key[own], seg.doc[lead], seg.a[lead])))
            if rows:
                yield _rows(rows)

    return run


def _first(batches):
    """For each entry 0 (stays), 1 (all of it repeats) or 2 (first, but its seed has other segments)."""
    at, held = None, []

    def flush():
        parts = [unpack(body) for _, body in held]
        sizes = [len(p[0]) for p in parts]
        s = np.concatenate([np.cumsum(p[0].astype(U64), dtype=U64) for p in parts])
        g, key, doc, a = (np.concatenate([p[k].astype(U64) for p in parts]) for k in (1, 2, 3, 4))
        block = np.repeat(np.array([b for b, _ in held], dtype=np.int64), sizes)
        order = np.lexsort((a, doc, block, key, g, s))
        s, g = s[order], g[order]
        new_s = np.concatenate([[True], s[1:] != s[:-1]])
        new = new_s | np.concatenate([[True], g[1:] != g[:-1]])
        several = np.add.reduceat(new, np.flatnonzero(new_s)) > 1
        code = np.empty(len(order), np.uint8)
        code[order] = np.where(new, np.where(several[np.cumsum(new_s) - 1], 2, 0), 1)
        cuts = np.cumsum([0, *sizes])
        rows = [(ENTRY, b, at, None, None, zstandard.compress(code[cuts[i] : cuts[i + 1]].tobytes(), 1)) for i, (b, _) in enumerate(held)]
        for i in range(0, len(rows), 1000):
            yield _rows(rows[i : i + 1000])

    for batch in batches:
        for block, bucket, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if bucket != at and held:
                yield from flush()
                held = []
            at = bucket
            held.append((block, body))
    if held:
        yield from flush()


def _by_block(batches):
    """(head, rows by kind) of each block, from rows sorted by block, kind and bucket."""
    head, parts = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            r = {k: batch.column(j)[i].as_py() for j, k in enumerate(_PARTS)}
            if r["kind"] == HEAD:
                if head:
                    yield head, parts
                head, parts = r, {ENTRY: [], MASK: []}
            else:
                parts[r["kind"]].append((r["bucket"], r["body"]))
    if head:
        yield head, parts


def _restore(head, parts, bloom: Bloom, buckets: int):
    data = np.frombuffer(zstandard.decompress(head["body"]), np.uint8)
    seg, e = block_entries(data, np.array(head["lens"], dtype=np.int64), head["doc_ids"], bloom, buckets)
    code = np.concatenate([np.frombuffer(zstandard.decompress(b), np.uint8) for _, b in parts[ENTRY]]) if parts[ENTRY] else np.zeros(0, np.uint8)
    return data, seg, e, code


def _send(held, buckets: int):
    """The bytes of the segments that need an index, by seed."""

    def run(batches):
        bloom = Bloom(held.value)
        for head, parts in _by_block(batches):
            data, seg, e, code = _restore(head, parts, bloom, buckets)
            rows = []
            for b in range(buckets):
                own = np.arange(e.cuts[b], e.cuts[b + 1])
                own = own[code[own] == 2]
                lead = e.lead[own]
                if len(lead):
                    size = seg.b[lead] - seg.a[lead] + LENGTH
                    body = np.concatenate([data[x : x + n] for x, n in zip(seg.a[lead], size, strict=True)]).tobytes()
                    info = pack(np.diff(e.seed[own], prepend=U64(0)), e.key[own], seg.doc[lead], seg.a[lead], seg.at[lead] - seg.a[lead], size)
                    rows.append((MASK, head["block"], b, None, None, len(info).to_bytes(8, "little") + info + zstandard.compress(body, 3)))
            if rows:
                yield _rows(rows)

    return run


def _index(batches):
    at, held = None, []

    def flush():
        infos, segs, owner = [], [], []
        for i, (_, body) in enumerate(held):
            n = int.from_bytes(body[:8], "little")
            info = unpack(body[8 : 8 + n])
            raw, pos = zstandard.decompress(body[8 + n :]), 0
            for size in info[5].tolist():
                segs.append(raw[pos : pos + size])
                pos += size
            infos.append([np.cumsum(info[0].astype(U64), dtype=U64), *(x.astype(U64) for x in info[1:5])])
            owner.append(np.full(len(info[5]), i))
        s, key, doc, a, place = (np.concatenate([x[k] for x in infos]) for k in range(5))
        owner = np.concatenate(owner)
        block = np.array([b for b, _ in held], dtype=np.int64)[owner]
        order = np.lexsort((a, doc, block, key, s))
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1]])), [len(order)]])
        mask = np.zeros(len(order), dtype=U64)
        batch, size = [], 0

        def index(some):
            where = np.concatenate(some)
            own = [segs[i] for i in where]
            mask[where] = group_masks(own, place[where].tolist()) if len(some) == 1 else masks_of(own)

        for x, y in zip(cuts[:-1], cuts[1:], strict=True):  # whole seeds together
            group = order[x:y]
            n = sum(len(segs[i]) for i in group)
            if batch and size + n > INDEX_BYTES:
                index(batch)
                batch, size = [], 0
            batch.append(group)
            size += n
        index(batch)
        rows = [(MASK, b, at, None, None, pack(mask[owner == i])) for i, (b, _) in enumerate(held)]
        for i in range(0, len(rows), 1000):
            yield _rows(rows[i : i + 1000])

    for batch in batches:
        for block, bucket, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if bucket != at and held:
                yield from flush()
                held = []
            at = bucket
            held.append((block, body))
    if held:
        yield from flush()


SPANS = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>"


def _cover(held, buckets: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        bloom = Bloom(held.value)
        for head, parts in _by_block(batches):
            data, seg, e, code = _restore(head, parts, bloom, buckets)
            mask = np.zeros(len(code), dtype=U64)
            mask[code == 1] = ~U64(0)
            if parts[MASK]:
                mask[code == 2] = np.concatenate([unpack(b)[0].astype(U64) for _, b in parts[MASK]])
            own = mask[e.of] if len(e.of) else np.zeros(0, U64)
            repeated = np.ones(len(seg.a), dtype=bool)
            repeated[e.lead] = False
            own[repeated] = ~U64(0)  # not the first in its own block
            change = np.zeros(len(data) + 1, dtype=np.int32)
            whole = own == ~U64(0)
            np.add.at(change, seg.a[whole], 1)
            np.add.at(change, seg.b[whole] + LENGTH, -1)
            for i in np.flatnonzero(~whole & (own != 0)):
                bits = int(own[i])
                starts = seg.a[i] + np.array([k for k in range(int(seg.b[i] - seg.a[i]) + 1) if bits >> k & 1], dtype=np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + LENGTH, -1)
            covered = np.cumsum(change[:-1]) > 0
            rows = []
            for i, doc in enumerate(head["doc_ids"]):
                x, y = seg.first[i], seg.first[i + 1]
                c = np.concatenate([[False], covered[x:y], [False]])
                turns = np.flatnonzero(c[1:] != c[:-1])
                rows.append((doc, int(y - x), data[x:y][~covered[x:y]].tobytes(), [{"start": int(a), "stop": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), kind), strict=True)], names=["doc_id", "n_bytes", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept, spans): the bytes that stay of every whole text, and the maximal runs that went."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(64, input_bytes(docs, "text") // BUCKET_BYTES)
    by_bucket = lambda df: df.repartition(F.col("bucket")).sortWithinPartitions("bucket", "block")
    by_block = lambda df: df.repartition(F.col("block")).sortWithinPartitions("block", "kind", "bucket")

    shared = shared_keys(docs.mapInArrow(lean(_seeds(buckets)), KEYS))
    held = spark.sparkContext.broadcast(bloom_words(shared))  # at most MAX_BLOCKS * 64 bytes
    parts = materialize(docs.mapInArrow(lean(_cut(held, buckets)), PARTS), "kind").select(*_PARTS)
    heads = parts.where(F.col("kind") == HEAD)
    codes = materialize(by_bucket(parts.where(F.col("kind") == ENTRY)).mapInArrow(lean(_first), PARTS))
    segments = by_block(heads.unionByName(codes)).mapInArrow(lean(_send(held, buckets)), PARTS)
    masks = by_bucket(segments).mapInArrow(lean(_index), PARTS)
    return by_block(heads.unionByName(codes).unionByName(masks)).mapInArrow(lean(_cover(held, buckets)), SPANS)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 100-byte strings."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
