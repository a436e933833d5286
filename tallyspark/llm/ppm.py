"""Language-model scores by prediction by partial matching (PPM), beside a smoothed word model.

Model. The corpus fills a byte-context trie of depth ORDER: counts of every byte after every context of up to ORDER
bytes, text start and end included. A symbol's probability comes from the longest context that was seen; a symbol that
was never seen there costs an escape (method D: half a count for each distinct symbol) and is looked for one byte
shorter, where the symbols of the longer context are left out (exclusion). Below the empty context all remaining
bytes are equally likely. The trie is trained first and then fixed, so the score of a text doesn't depend on others.

Plan. Documents are cut into blocks. A block sends its distinct (ORDER + 1)-grams and its distinct words (64-bit hashes)
with their training counts, dealt out by hash bucket, and its packed texts. Buckets add up counts; a text's gram and word
occurrences never leave their block. Distinct grams then meet by the last two bytes of their context, which makes every
context of two bytes or more whole in one place (of bounded size, as the alphabet is) while shorter contexts are a table
of at most 65,536 rows. Log probabilities and counts go back to the blocks by bucket, and each block adds up its texts.
The number of buckets follows the input, so neither a bucket nor a block grows with it, and nothing that grows with the
corpus is broadcast or collected.

Null text counts as empty (its end is still scored); null ids are trained on (remainder 0 is a matter of the caller's
condition); repeated rows count and are scored each; an empty table gives an empty result, and a table without training
rows gives uniform scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Sums, Words, blocks, input_bytes, lean, materialize, mix, pack, pack_keys, texts, unpack, unpack_keys
from .langid import remainder

ORDER = 4
EDGE = 255  # no byte of UTF-8; stands before the start and for the end
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 32 << 20
HEAD, WORD, GRAM = 0, 1, 2
PARTS = "kind int, block long, bucket int, doc_ids array<long>, lens array<int>, body binary"
_PARTS = {"kind": pa.int32(), "block": pa.int64(), "bucket": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lens": pa.list_(pa.int32()), "body": pa.binary()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTS.values(), strict=True)], names=list(_PARTS))


def lowered(raw: bytes) -> bytes:
    """A-Z in lower case; bytes.lower does only these."""
    return raw.lower()


def grams_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text): the (ORDER + 1)-gram that ends at each byte, and at the end, of each text; with its text's number."""
    pad = bytes([EDGE]) * ORDER
    data = np.frombuffer(b"".join([x for t in raw for x in (pad, t, pad[:1])]), dtype=np.uint8)
    code = np.zeros(max(0, len(data) - ORDER), dtype=U64)
    for k in range(ORDER + 1):
        code = (code << U64(8)) | data[k : len(data) - ORDER + k]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    ends = np.cumsum(sizes + ORDER)
    keep = np.ones(len(code), dtype=bool)
    for k in range(ORDER):  # windows that end in the next text's pad
        at = ends[:-1] + k - ORDER
        keep[at] = False
    return code[keep], np.repeat(np.arange(len(raw)), sizes)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys.copy()) >> U64(33)) % U64(buckets)).astype(np.int32)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted; how many of each are of training texts)."""
    distinct = np.sort(keys)
    if len(distinct):
        distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
    own = np.sort(keys[train])
    return distinct, np.searchsorted(own, distinct, "right") - np.searchsorted(own, distinct)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of sorted keys in the order of buckets, where each bucket starts)."""
    bucket = bucket_of(keys, buckets)
    place = np.argsort(bucket, kind="stable")
    return place, np.searchsorted(bucket[place], np.arange(buckets + 1))


def _cut(buckets: int):
    def run(batches):
        number = 0
        for block in blocks(batches, "text", BLOCK_BYTES):
            key = (TaskContext.get().partitionId() << 32) + number
            number += 1
            raw = [lowered(t.encode()) for t in texts(block, "text")]
            train = np.array(block.column(2).to_pylist(), dtype=bool)
            lens = [len(t) if on else -len(t) - 1 for t, on in zip(raw, train, strict=True)]  # a held-out text's is negative
            yield _rows([(HEAD, key, -1, block.column(0).to_pylist(), lens, zstandard.compress(b"".join(raw), 1))])
            words = Words(raw)
            of = np.repeat(np.arange(len(raw)), np.diff(words.first))
            codes, text = grams_of(raw)
            for kind, keys, own in ((WORD, words.hash, train[of]), (GRAM, codes, train[text])):
                distinct, counts = counted(keys, own)
                place, cuts = dealt(distinct, buckets)
                rows = [(kind, key, b, None, None, pack_keys(distinct[p], counts[p])) for b in range(buckets) if len(p := place[cuts[b] : cuts[b + 1]])]
                if rows:
                    yield _rows(rows)

    return run


def _by_bucket(batches):
    """Rows of one bucket after another: (bucket, rows), from rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != at and held:
                yield at, held
                held = []
            at = r["bucket"]
            held.append(r)
    if held:
        yield at, held


def _word_counts(batches):
    """Back to each block: the corpus count of each of its words. Block -1 has the number of distinct training words."""
    for bucket, rows in _by_bucket(batches):
        sums = Sums()
        for r in rows:
            sums.add(*unpack_keys(r["body"]))
        keys, counts = sums.total()
        yield _rows([(WORD, -1, bucket, [int((counts > 0).sum()), int(counts.sum())], None, None)])
        out = [(WORD, r["block"], bucket, None, None, pack(counts[np.searchsorted(keys, unpack_keys(r["body"])[0])])) for r in rows]
        for i in range(0, len(out), 256):
            yield _rows(out[i : i + 256])


def _gram_sums(batches):
    for bucket, rows in _by_bucket(batches):
        sums = Sums()
        for r in rows:
            sums.add(*unpack_keys(r["body"]))
        keys, counts = sums.total()
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, np.int32)), pa.array(part), pa.array(counts[i : i + 50_000])], names=["bucket", "gram", "n"])


class Trie:
    """Counts of the contexts of up to one byte, and what follows from a group of longer ones; see logs()."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.n1 = np.zeros((256, 256))
        for code, n in pairs:
            self.n1[code >> 8, code & 255] = n
        self.n0 = self.n1.sum(axis=0)
        self.total, self.distinct = self.n0.sum(), int((self.n0 > 0).sum())

    def logs(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others. codes hold all grams of one pair of last
        context bytes, n their training counts."""
        last = int(codes[0] >> U64(8)) & 255
        b0, b1, s = (codes >> U64(32)).astype(np.int64) & 255, (codes >> U64(24)).astype(np.int64) & 255, codes.astype(np.int64) & 255
        n = n.astype(np.float64)
        seen = n > 0
        n3 = np.bincount(b1 * 256 + s, n, 65536).reshape(256, 256)
        n2 = n3.sum(axis=0)
        n1, n0 = self.n1[last], self.n0
        c4 = b0 * 256 + b1
        # of each context: count, distinct symbols, and the count that these symbols have one byte shorter
        levels = [
            (n, *(np.bincount(c4[seen], w[seen], 65536)[c4] for w in (n, seen.astype(float), n3[b1, s]))),
            (n3[b1, s], n3.sum(1)[b1], (n3 > 0).sum(1)[b1], ((n3 > 0) @ n2)[b1]),
            (n2[s], n2.sum(), (n2 > 0).sum(), n1[n2 > 0].sum()),
            (n1[s], n1.sum(), (n1 > 0).sum(), n0[n1 > 0].sum()),
            (n0[s], self.total, self.distinct, 0.0),
        ]
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), dtype=bool)
        skip_n, skip_d = 0.0, 0.0
        for own, count, distinct, below in levels:
            count, distinct_left = count - skip_n, distinct - skip_d
            total = np.broadcast_to(2 * count, out.shape)
            hit = open_ & (own > 0)
            out[hit] += np.log10((2 * own[hit] - 1) / total[hit])
            open_ &= ~hit
            escape = open_ & (total > 0)
            out[escape] += np.log10(np.broadcast_to(distinct_left, out.shape)[escape] / total[escape])
            skip_n, skip_d = below, distinct
        out[open_] -= math.log10(256 - self.distinct) if self.distinct < 256 else 0.0
        return out


def _gram_logs(held):
    """From grams sorted by the last two bytes of their context: their log probability, by the bucket they came from."""

    def run(batches):
        trie, at, parts = Trie(held.value), None, []

        def flush():
            codes = np.concatenate([c for _, c, _ in parts])
            logs = trie.logs(codes, np.concatenate([n for _, _, n in parts]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([b for b, _, _ in parts])), pa.array(codes.astype(np.int64)), pa.array(logs.astype(np.float32))], names=["bucket", "gram", "log"])

        for batch in batches:
            bucket, code, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            code = code.astype(U64)
            pair = (code >> U64(8)) & U64(0xFFFF)
            cuts = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if pair[a] != at and parts:
                    yield flush()
                    parts = []
                at = pair[a]
                parts.append((bucket[a:b], code[a:b], n[a:b]))
        if parts:
            yield flush()

    return run


def _pack_logs(batches):
    """Log probabilities, sorted by bucket and gram, as rows of block -1 that stand before the blocks' own."""
    at, grams, logs = None, [], []
    for batch in batches:
        bucket, gram, log = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _rows([(GRAM, -1, int(bucket[a]), None, None, pack(np.diff(gram[a:b].astype(U64), prepend=U64(0)), log[a:b].view(np.uint32)))])


def _gram_back(batches):
    """Back to each block: the log probability of each of its grams."""
    at, keys, logs = None, None, []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["bucket"] != at:
                at, keys, logs = r["bucket"], [], []
            if r["block"] < 0:
                steps, bits = unpack(r["body"])
                keys.append(np.cumsum(steps.astype(U64), dtype=U64))
                logs.append(bits.astype(np.uint32).view(np.float32))
                continue
            if isinstance(keys, list):
                keys, logs = np.concatenate(keys), np.concatenate(logs)
                order = np.argsort(keys)
                keys, logs = keys[order], logs[order]
            own = logs[np.searchsorted(keys, unpack_keys(r["body"])[0])]
            out.append((GRAM, r["block"], at, None, None, zstandard.compress(own.tobytes(), 1)))
        if out:
            yield _rows(out)


class Lookup:
    """Values by 64-bit key: a table four times as large as the keys, with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, U64(64 - bits)
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.values = np.zeros(1 << bits, dtype=values.dtype)
        used = np.zeros(1 << bits, dtype=bool)
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[~used[slot[left]]]
            self.keys[slot[free]] = keys[free]  # of several on one slot, the last one written stays
            used[slot[free]] = True
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        slot = self.slots(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return self.values[slot]


def _sum_texts(buckets: int, end_count: int):
    names = ["doc_id", "train", "n_tokens", "n_known", "word_logs", "score"]

    def flush(head, words_back, grams_back):
        data, raw, at = zstandard.decompress(head["body"]), [], 0
        train = [n >= 0 for n in head["lens"]]
        for n in head["lens"]:
            n = n if n >= 0 else -n - 1
            raw.append(data[at : at + n])
            at += n
        words = Words(raw)

        def table(keys, parts, dtype):
            distinct = np.sort(keys)
            distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])] if len(distinct) else distinct
            place, _ = dealt(distinct, buckets)
            return Lookup(distinct[place], np.concatenate(parts) if parts else np.zeros(0, dtype))

        count = table(words.hash, [unpack(b)[0].astype(np.int64) for b in words_back], np.int64).get(words.hash)
        of = np.repeat(np.arange(len(raw)), np.diff(words.first))
        known = np.bincount(of, count > 0, len(raw)).astype(np.int64) + (end_count > 0)
        logs = np.bincount(of, np.log10(count + 0.1), len(raw)) + math.log10(end_count + 0.1)
        codes, text = grams_of(raw)
        score = np.bincount(text, table(codes, [np.frombuffer(zstandard.decompress(b), np.float32) for b in grams_back], np.float32).get(codes).astype(np.float64), len(raw))
        return pa.RecordBatch.from_arrays([pa.array(head["doc_ids"], pa.int64()), pa.array(train), pa.array(np.diff(words.first) + 1), pa.array(known), pa.array(logs), pa.array(score)], names=names)

    def run(batches):
        head, words_back, grams_back = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(j)[i].as_py() for j, k in enumerate(_PARTS)}
                if r["kind"] == HEAD:
                    if head:
                        yield flush(head, words_back, grams_back)
                    head, words_back, grams_back = r, [], []
                else:
                    (words_back if r["kind"] == WORD else grams_back).append(r["body"])
        if head:
            yield flush(head, words_back, grams_back)

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every whole text by
    the word model and by PPM, both learned from the rows where train holds (null: they don't teach)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    buckets = max(64, input_bytes(docs, "text") // BUCKET_BYTES)
    parts = materialize(docs.mapInArrow(lean(_cut(buckets)), PARTS), "kind")
    parts = parts.select(*_PARTS)
    by_bucket = lambda df: df.repartition(F.col("bucket")).sortWithinPartitions("bucket", "block")

    words = materialize(by_bucket(parts.where(F.col("kind") == WORD)).mapInArrow(lean(_word_counts), PARTS))
    totals = words.where("block < 0").agg(F.sum(F.col("doc_ids")[0]).alias("v"), F.sum(F.col("doc_ids")[1]).alias("n")).first()
    teaches = F.size(F.filter("lens", lambda x: x >= 0))
    ends = parts.where(F.col("kind") == HEAD).agg(F.sum(teaches).alias("n")).first()["n"] or 0
    n_all, distinct = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)

    grams = materialize(by_bucket(parts.where(F.col("kind") == GRAM)).mapInArrow(lean(_gram_sums), "bucket int, gram long, n long"))
    pair = F.expr("shiftright(gram, 8) & 65535")
    short = grams.groupBy(F.expr("gram & 65535").alias("code")).agg(F.sum("n").alias("n"))
    held = spark.sparkContext.broadcast([(r["code"], r["n"]) for r in short.collect()])  # at most 65,536 rows
    logs = grams.withColumn("pair", pair).repartition(F.col("pair")).sortWithinPartitions("pair").drop("pair")
    logs = logs.mapInArrow(lean(_gram_logs(held)), "bucket int, gram long, log float")
    logs = logs.repartition(F.col("bucket")).sortWithinPartitions("bucket", "gram").mapInArrow(lean(_pack_logs), PARTS)
    back = by_bucket(logs.unionByName(parts.where(F.col("kind") == GRAM))).mapInArrow(lean(_gram_back), PARTS)

    whole = parts.where(F.col("kind") == HEAD).unionByName(words.where("block >= 0")).unionByName(back)
    whole = whole.repartition(F.col("block")).sortWithinPartitions("block", "kind", "bucket")
    sums = whole.mapInArrow(lean(_sum_texts(buckets, ends)), "doc_id long, train boolean, n_tokens long, n_known long, word_logs double, score double")
    per_token = math.log10(n_all + 0.1 * (distinct + 1))
    base = F.col("word_logs") - F.col("n_tokens") * F.lit(per_token)
    return sums.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_ppm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by models of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, remainder("doc_id", 10) != 0)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
