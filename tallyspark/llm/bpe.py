"""Byte-level BPE by a shuffle of distinct words.

encode(): every partition cuts its texts into blocks and each text into pre-tokens with their positions. A block keeps
its positions as a packed sequence of local word numbers and deals its distinct words into buckets by hash. One shuffle
brings the words of a bucket together, where each distinct word is encoded once and its ids are joined back to every
block that has it. A second shuffle brings ids and positions of a block together again. Words, never pre-token
occurrences, cross the network, and a frequent word is one entry per block, so no key is hot.

decode() joins every id with the token-byte table, which has as many rows as the vocabulary and is therefore broadcast.

Null text counts as empty and gives no ids; rows with equal or null ids are kept as they are; input columns other than
the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, input_bytes, lean, pack, texts, unpack

BLOCK_BYTES = 12 << 20
PARTS = "block long, bucket int, doc_ids array<long>, lens array<int>, body binary"

_encoders: dict[bytes, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file (token in base64, a space, its rank, per line); the driver reads it and broadcasts it."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def _encoder(raw: bytes, pattern: str):
    key = hashlib.sha256(raw + pattern.encode()).digest()
    if key not in _encoders:
        import tiktoken

        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(raw), special_tokens={})
    return _encoders[key]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
    names = ("block", "bucket", "doc_ids", "lens", "body")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _pretokenize(pattern: str, id_col: str, text_col: str, buckets: int, block_bytes: int):
    def run(batches):
        import regex

        find, number = regex.compile(pattern).findall, 0
        for block in blocks(batches, text_col, block_bytes):
            key = (TaskContext.get().partitionId() << 32) + number
            number += 1
            local: defaultdict = defaultdict()
            local.default_factory = local.__len__
            seqs = [np.fromiter(map(local.__getitem__, find(t)), np.int32) for t in texts(block, text_col)]
            seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
            words = [w.encode() for w in local]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
            # frequent words get small numbers; words of equal count stand by bucket and spelling, which packs well
            spelling = np.empty(len(words), np.int64)
            spelling[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            order = np.lexsort((spelling, bucket, -np.bincount(seq, minlength=len(words))))
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            f = rank[seq]
            low = f < 255
            ids = block.column(block.schema.get_field_index(id_col)).to_pylist()
            yield _rows([(key, -1, ids, [len(s) for s in seqs], pack(np.where(low, f, 255), f[~low] - 255))])
            place = np.argsort(bucket[order], kind="stable")  # ranks, bucket by bucket, ascending within each
            cuts = np.searchsorted(bucket[order][place], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                if len(ranks := place[cuts[b] : cuts[b + 1]]):
                    own = [words[order[r]] for r in ranks]
                    out.append((key, b, None, None, zstandard.compress(pack_words(own, np.diff(ranks, prepend=0)), 3)))
            if out:
                yield _rows(out)

    return run


def pack_words(words: list[bytes], steps: np.ndarray) -> bytes:
    lens = np.fromiter(map(len, words), np.int64, len(words))
    head = pack(lens, steps)
    return len(head).to_bytes(8, "little") + head + b"".join(words)


def unpack_words(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    lens, steps = unpack(raw[8 : 8 + n])
    ends = (8 + n + np.cumsum(lens.astype(np.int64))).tolist()
    return [raw[a:b] for a, b in zip([8 + n, *ends[:-1]], ends, strict=True)], steps


def _encode_words(ranks, pattern: str):
    """Bucket by bucket: each distinct word is encoded once, whichever block it comes from."""

    def run(batches):
        encode = _encoder(ranks.value, pattern)._encode_single_piece
        at, known = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    out.append((row["block"], -1, row["doc_ids"], row["lens"], row["body"]))
                    continue
                if row["bucket"] != at:
                    at, known = row["bucket"], {}
                words, steps = unpack_words(zstandard.decompress(row["body"]))
                ids = []
                for w in words:
                    if (got := known.get(w)) is None:
                        got = known[w] = encode(w)
                    ids.append(got)
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(lens.sum()))
                out.append((row["block"], row["bucket"], None, None, pack(lens, flat, steps)))
                if len(out) >= 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _reassemble(id_col: str):
    def flush(head, parts):
        low, rest = unpack(head["body"])
        seq = low.astype(np.int64)
        seq[low == 255] = rest.astype(np.int64) + 255
        lens, flats, ranks = [], [], []
        for p in parts:
            a, b, steps = unpack(p)
            lens.append(a.astype(np.int64)), flats.append(b.astype(np.int32)), ranks.append(np.cumsum(steps.astype(np.int64)))
        empty = [np.zeros(0, np.int64)]
        lens, flat, ranks = np.concatenate(lens or empty), np.concatenate(flats or empty).astype(np.int32), np.concatenate(ranks or empty)
        starts = np.cumsum(lens) - lens
        start, length = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        start[ranks], length[ranks] = starts, lens
        at = 0
        doc_ids, arrays = [], []
        size = 0
        for doc, n in zip(head["doc_ids"], head["lens"], strict=True):
            s = seq[at : at + n]
            at += n
            k = length[s]
            ends = np.cumsum(k)
            total = int(ends[-1]) if n else 0
            arrays.append(flat[np.repeat(start[s] - (ends - k), k) + np.arange(total)])
            doc_ids.append(doc)
            size += total
            if size >= 2_000_000:
                yield ids_batch(id_col, doc_ids, arrays)
                doc_ids, arrays, size = [], [], 0
        if doc_ids:
            yield ids_batch(id_col, doc_ids, arrays)

    def run(batches):
        head, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    if head:
                        yield from flush(head, parts)
                    head, parts = row, []
                else:
                    parts.append(row["body"])
        if head:
            yield from flush(head, parts)

    return run


def ids_batch(id_col: str, doc_ids: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=[id_col, "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, ids array<int>): the ids of each whole text, pre-token by pre-token, without special tokens. Larger blocks
    send fewer words and need more memory in a task."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    buckets = max(64, math.isqrt(input_bytes(docs, text_col) >> 16))  # as many as a block and a bucket both stay of a size
    parts = docs.mapInArrow(lean(_pretokenize(pattern, id_col, text_col, buckets, block_bytes)), PARTS)
    # words meet by bucket; positions, in bucket -1, are dealt out by block and pass through
    by_word = parts.repartition(F.expr("CASE WHEN bucket < 0 THEN block ELSE bucket END")).sortWithinPartitions("bucket")
    coded = by_word.mapInArrow(lean(_encode_words(ranks, pattern)), PARTS)
    whole = coded.repartition(F.col("block")).sortWithinPartitions("block", "bucket")
    return whole.mapInArrow(lean(_reassemble(id_col)), f"`{id_col}` long, ids array<int>")


def _decode(table, ids_col: str, schema_names: list[str]):
    def run(batches):
        tokens = table.value
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                # Python objects of one text at a time
                out = [None if x.values is None else b"".join([tokens[i] for i in x.values.to_pylist()]) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*schema_names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a binary column decoded; an id that the table lacks is an error."""
    table = {i: b for b, i in ranks_of(read_ranks(ranks_path)).items()}
    held = encoded.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(lean(_decode(held, ids_col, encoded.columns)), schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes read back from them, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
