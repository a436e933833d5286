"""What several operators share: scratch tables, Arrow block iteration, rolling hashes, word spans."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import resource
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import work_dir

U64 = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write once to the shared folder and read back: the lineage is cut and no later stage computes df again."""
    spark = df.sparkSession
    path = work_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """names for new columns; one that df has already gets underscores until it is free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def input_bytes(df: DataFrame, text_col: str) -> int:
    """About how large a table is, used only to choose a number of buckets: Catalyst's estimate or, where it has none
    (a plan of unknown size counts as exabytes), the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 52:
        return size
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


#: a worker that holds less than so many bytes is left as it is; many small tasks would spend their time on it
TRIM_ABOVE = 256 << 20


def trim() -> None:
    """Give back what earlier tasks of this worker have left; workers live as long as their executor."""
    with contextlib.suppress(OSError, ValueError, IndexError):  # other systems have no /proc
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * resource.getpagesize() < TRIM_ABOVE:
                return
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """run, a function for mapInArrow, with a trim before it and after all that it held is gone."""

    def task(batches):
        trim()
        yield from run(batches)
        trim()

    return task


def blocks(batches: Iterable[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut and join Arrow batches into blocks of about `most` text bytes; a single longer text is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0)
        start = 0
        for i, n in enumerate(lengths.to_pylist()):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield joined(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held and sum(b.num_rows for b in held):
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows]
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]


#: a blocked Bloom filter: so many bits for each key, as long as it has at most so many blocks of 512 bits
BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 17


def _bloom_bits(key: Column) -> list[Column]:
    """One bit for each of a block's eight words, from a second hash of the key."""
    h = F.xxhash64(F.lit(7), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]


def bloom_filter(df: DataFrame, key: Column, most: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The blocked Bloom filter of a hashed key as rows (_block, _w0.._w7), and its number of blocks, at most `most`."""
    n, blocks_ = df.agg(F.approx_count_distinct(key)).first()[0], 1
    while blocks_ < most and blocks_ * 512 < n * BITS_PER_KEY:
        blocks_ *= 2
    bits = df.select(F.pmod(key, F.lit(blocks_)).alias("_block"), *(b.alias(f"_w{i}") for i, b in enumerate(_bloom_bits(key))))
    return bits.groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(8))), blocks_


def bloom_passes(df: DataFrame, words: DataFrame, blocks_: int, key: Column, flag: str = "") -> DataFrame:
    """The rows of df that the filter passes; or all, with a boolean column named flag. The filter is broadcast, as its
    size is bounded."""
    df = df.withColumn("_block", F.pmod(key, F.lit(blocks_))).join(F.broadcast(words), "_block", "left" if flag else "inner")
    found = F.lit(True)
    for i, b in enumerate(_bloom_bits(key)):
        found = found & (F.col(f"_w{i}").bitwiseAND(b) != 0)
    df = df.withColumn(flag, F.coalesce(found, F.lit(False))) if flag else df.where(found)
    return df.drop("_block", *(f"_w{i}" for i in range(8)))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, each as width and length, in one compressed string."""
    out = bytearray()
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w))
        out += width.to_bytes(1, "little") + len(a).to_bytes(8, "little") + a.astype(f"<u{width}").tobytes()
    return zstandard.compress(bytes(out), 1)


def unpack(body: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(body), 0, []
    while at < len(raw):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 9))
        at += 9 + width * n
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mix, in place on uint64."""
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def _table(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U64) + U64(seed * 1000)) * U64(0xD6E8FEB86659FD93))


class Rolling:
    """Polynomial hashes modulo 2**64 of any byte span of a buffer, from one pass of prefix sums.

    Each byte goes through a table of random words first. hash(a, b) depends on bytes [a, b) only.
    """

    BASE = 0x5851F42D4C957F2D
    INVERSE = pow(BASE, -1, 1 << 64)
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data) + 1
        up, self.down = self.powers(n)
        self.prefix = np.zeros(n, dtype=U64)
        np.cumsum(_table(seed)[data] * up[: n - 1], out=self.prefix[1:])

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(0)
        if held is None or len(held[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            held = tuple(np.concatenate([[U64(1)], np.full(size - 1, U64(b))]) for b in (cls.BASE, cls.INVERSE))
            held = tuple(np.cumprod(h, dtype=U64) for h in held)
            cls._powers[0] = held
        return held

    def hash(self, start, stop) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.down[start])


class Words:
    """Words of a list of UTF-8 texts laid end to end, with a hash of each; by default `[^\\x20\\x09-\\x0D]+`."""

    def __init__(self, raw: list[bytes], lower: bool = False, seed: int = 1, separators: np.ndarray = WHITE):
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
        white = separators[self.data]
        before = np.concatenate([[True], white[:-1]])
        self.start = np.flatnonzero(~white & before)
        self.stop = np.flatnonzero(white & ~before)
        self.hash = self._hashes(seed)
        #: words of text i are [first[i], first[i + 1])
        self.first = np.concatenate([np.searchsorted(self.start, self.text_start), [len(self.start)]]).astype(np.int64)


    #: bytes hashed at a time; memory beyond the data itself follows this, not the block
    PIECE = 1 << 18

    def _hashes(self, seed: int) -> np.ndarray:
        """Rolling(data, seed).hash(start, stop), a piece of the data at a time, without prefix sums of all of it."""
        out, table = np.empty(len(self.start), dtype=U64), _table(seed)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + self.PIECE)))
            size = self.stop[i:j] - self.start[i:j]
            head = np.cumsum(size) - size
            offset = np.arange(int(size.sum())) - np.repeat(head, size)
            powers = Rolling.powers(int(size.max()) + 1)[0]
            out[i:j] = np.add.reduceat(table[self.data[offset + np.repeat(self.start[i:j], size)]] * powers[offset], head)
            i = j
        return mix(out)


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)), counts)


def unpack_keys(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpack(body)
    return np.cumsum(steps.astype(U64), dtype=U64), counts.astype(np.int64)


class Sums:
    """Counts by key, added up as they come; memory follows the distinct keys."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if len(self.parts) > 1 and self.size > 2 * len(self.parts[0][0]) + 500_000:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys = np.concatenate([k for k, _ in self.parts])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[first], np.add.reduceat(np.concatenate([c for _, c in self.parts])[order], first))]
            self.size = len(first)
        return self.parts[0]


#: packed 64-bit hashes of a block, by bucket
KEYS = "bucket int, body binary"


def packed_keys(keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of KEYS: a block's distinct keys, and whether each occurs once or more often in it."""
    keys, counts = np.unique(keys, return_counts=True)
    bucket = (keys % U64(buckets)).astype(np.int32)
    place = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[place], np.arange(buckets + 1))
    rows = [(b, pack_keys(keys[p], np.minimum(counts[p], 2))) for b in range(buckets) if len(p := place[cuts[b] : cuts[b + 1]])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "body"])


def _shared(batches):
    at, sums = None, None

    def flush():
        keys, counts = sums.total()
        keys = keys[counts > 1].view(np.int64)
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000])], names=["key"])

    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at:
                if sums:
                    yield from flush()
                at, sums = bucket, Sums()
            sums.add(*unpack_keys(body))
    if sums:
        yield from flush()


def shared_keys(packed: DataFrame) -> DataFrame:
    """(key): the keys that occur twice or more in all blocks, from rows of KEYS; written out."""
    return materialize(packed.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(_shared), "key long"))


class Bloom:
    """A blocked Bloom filter over 64-bit hashes for tasks in Python; the same bits as bloom_words."""

    def __init__(self, words: np.ndarray):
        self.words = words  # blocks x 8
        self.shift = U64(64 - (len(words).bit_length() - 1)) if len(words) > 1 else None

    def passes(self, keys: np.ndarray) -> np.ndarray:
        block = (keys >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(keys), np.int64)
        ok = np.ones(len(keys), dtype=bool)
        for i in range(8):
            ok &= (self.words[block, i] >> ((keys >> U64(6 * i)) & U64(63))) & U64(1) == 1
        return ok


def bloom_words(shared: DataFrame) -> np.ndarray:
    """The words of the filter of shared.key, at most MAX_BLOCKS * 64 bytes, for the driver to broadcast."""
    n, size = shared.count(), 1
    while size < MAX_BLOCKS and size * 512 < BITS_PER_KEY * n:
        size *= 2
    block = F.shiftrightunsigned("key", 64 - (size.bit_length() - 1)) if size > 1 else F.lit(0).cast("long")
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("key", 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]
    rows = shared.select(block.alias("b"), *(x.alias(f"w{i}") for i, x in enumerate(bit))).groupBy("b").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toArrow()
    words = np.zeros((size, 8), dtype=np.int64)
    at = rows.column("b").to_numpy()
    for i in range(8):
        words[at, i] = rows.column(f"w{i}").to_numpy()
    return words.view(U64)


#: rows of ids to leave out that are still sent to every task
MOST_BROADCAST = 2_000_000


def without(df: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """The rows of df that match none of gone (a table of keys). gone is written and counted: up to MOST_BROADCAST rows are
    broadcast, so that df isn't shuffled; more are joined by key."""
    gone = materialize(gone)
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return df.join(gone, on, "left_anti")
