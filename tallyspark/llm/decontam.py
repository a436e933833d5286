"""Benchmark decontamination: pairs of neighbouring words as seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes beyond ASCII, in lower case (A-Z), so punctuation and line breaks don't
matter. A seed is two neighbouring words of an item that follow each other in a document, or with one word between. No
copy is lost to the seeds: an alignment of an item of n words that scores T or more holds (2 T - n) / 3 - 1 such pairs
or more, at distinct words, within 3 n - T words of the document. (Of m matches, 2 m less the edits is T or more. Where two
matches in a row are no such pair, either a word of the item is left out, or two of the document or more.) One pass over
all documents counts every pair; each item leaves out as many of its most frequent ones as still leave TOGETHER that any
copy must have, so an item that has leaked into a third of all documents still has its seeds. A second pass finds the
seeds in every whole text and aligns the item with the words around each TOGETHER of them that stand close enough (local
alignment, MATCH, MISMATCH, GAP), so edited, cut and paraphrased copies score by what they share.

The benchmark goes to the tasks in blocks of at most BLOCK_ITEM_WORDS words, whatever its size; each block is one stated
query set against all documents. Documents are never shuffled; what leaves a task is a row per document and item that
align. Counts are aggregated in every task first.

Null texts and items have no words. An item of fewer than LEAST_ITEM words matches nothing. Equal items or
repeated documents give a row each. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, blocks, lean, mix, texts, without
from .orderminhash import content

LEAST_ITEM = 3
#: so many seeds of a copy are asked for, or all that the shortest items have for certain
TOGETHER = 4
#: sure_pairs and most_words follow from these
MATCH, MISMATCH, GAP = 2, -1, -1
#: a copy has this share of the item's best score, and of the score of so many words in a row (or of all, in short items)
LEAST_SHARE, LEAST_WORDS = 0.5, 8
BLOCK_ITEM_WORDS = 1 << 20
BLOCK_BYTES = 4 << 20
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(raw: list[bytes]) -> Words:
    return Words(raw, lower=True, separators=_BREAK)


def pairs(words: Words, apart: int = 1) -> np.ndarray:
    """The hash of each word with the one `apart` words on; 0 where the text ends before."""
    h = words.hash
    out = np.zeros(len(h), dtype=U64)
    if len(h) > apart:
        out[:-apart] = mix(h[:-apart] * U64(0x9E3779B97F4A7C15) + h[apart:]) | U64(1)
    for k in range(1, apart + 1):
        out[np.maximum(words.first[1:] - k, words.first[:-1])[words.first[1:] > words.first[:-1]]] = 0
    return out


class Seeds:
    """Sorted n-grams with a bit table in front, as most words of a document start no seed."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        bits = 22
        self.shift = U64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(grams >> self.shift).astype(np.int64)] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in found, places in grams) of what is a seed."""
        at = np.flatnonzero(self.table[(found >> self.shift).astype(np.int64)] & (found != 0))
        if not len(at) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.grams, found[at]), len(self.grams) - 1)
        same = self.grams[place] == found[at]
        return at[same], place[same]


def _count(held, text_col: str):
    def run(batches):
        seeds = Seeds(held.value)
        total = np.zeros(len(seeds.grams), dtype=np.int64)
        for block in blocks(batches, text_col, BLOCK_BYTES):
            words = words_of([t.encode() for t in texts(block, text_col)])
            for apart in (1, 2):
                total += np.bincount(seeds.find(pairs(words, apart))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return run


def align(item: np.ndarray, sides: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(score, start, stop) of the best local alignment of item with each side: the words [start, stop) of the side."""
    width = max(map(len, sides))
    side = np.zeros((len(sides), width + 1), dtype=U64)
    for k, s in enumerate(sides):
        side[k, 1 : len(s) + 1] = s
    held = np.arange(width + 1) <= np.array([[len(s)] for s in sides])
    steps = np.arange(width + 1, dtype=np.int64) * -GAP
    big = np.int64(width + 2)
    # each cell holds score * big + (width + 1 - start), so of equal scores the earliest start wins and travels along
    empty = big - 1 - np.arange(width + 1, dtype=np.int64)
    row = np.broadcast_to(empty, side.shape).copy()
    best, stop = np.full(len(sides), np.int64(0)), np.zeros(len(sides), np.int64)
    for word in item:
        new = np.broadcast_to(empty, side.shape).copy()
        np.maximum(new, row + GAP * big, out=new)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(side[:, 1:] == word, MATCH, MISMATCH) * big)
        new = np.maximum.accumulate(new + steps * big, axis=1) - steps * big
        np.maximum(new, empty, out=new)
        row = np.where(held, new, empty)
        top = row.argmax(axis=1)
        value = row[np.arange(len(sides)), top]
        better = value // big > best // big
        best[better], stop[better] = value[better], top[better]
    return [(int(b // big), int(big - 1 - b % big) if b >= big else 0, int(s)) for b, s in zip(best, stop, strict=True)]


def least_score(words):
    return np.maximum(LEAST_SHARE * MATCH * words, MATCH * np.minimum(LEAST_WORDS, words))


def passes(score: int, words: int) -> bool:
    return bool(score >= least_score(words))


def sure_pairs(words):
    """So many seeds has every alignment that passes, one at least."""
    return np.maximum(np.ceil((2 * least_score(words) - words) / 3 - 1), 1).astype(np.int64)


def most_words(words):
    """So many words of a document has an alignment that passes at most."""
    return np.floor(3 * words - least_score(words)).astype(np.int64)


_PAIR = {"doc_id": pa.int64(), "item_id": pa.int64(), "score": pa.int64(), "similarity": pa.float64(), "start_word": pa.int64(), "stop_word": pa.int64(), "c": pa.binary()}


def _search(held, id_col: str, text_col: str):
    def run(batches):
        grams, owner_first, owner, item_ids, item_words, item_first = held.value
        seeds = Seeds(grams)
        sizes = np.diff(item_first)
        asked, reach = np.minimum(sure_pairs(sizes), TOGETHER), most_words(sizes)
        for block in blocks(batches, text_col, BLOCK_BYTES):
            raw = [t.encode() for t in texts(block, text_col)]
            words = words_of(raw)
            at, seed = (np.concatenate(x) for x in zip(*(seeds.find(pairs(words, apart)) for apart in (1, 2)), strict=True))
            # a seed may belong to several items, or to several places of one
            n = owner_first[seed + 1] - owner_first[seed]
            own = np.repeat(owner_first[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hits = np.unique(owner[own] * np.int64(len(words.hash) + 1) + np.repeat(at, n))
            item, at = hits // (len(words.hash) + 1), hits % (len(words.hash) + 1)
            doc = np.searchsorted(words.first, at, side="right") - 1
            # as many as are asked for, close together
            last = np.arange(len(hits)) + asked[item] - 1
            near = np.flatnonzero(last < len(hits))
            last = last[near]
            near_enough = (item[last] == item[near]) & (doc[last] == doc[near]) & (at[last] - at[near] < reach[item[near]])
            near, last = near[near_enough], last[near_enough]
            if not len(near):
                continue
            item, doc = item[near], doc[near]
            start = np.maximum(at[last] + 2 - reach[item], words.first[doc])
            stop = np.minimum(at[near] + reach[item], words.first[doc + 1])
            # windows of one item in one document that overlap are one window; both ends ascend
            new = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
            heads = np.flatnonzero(np.concatenate([[True], new]))
            ends = stop[np.flatnonzero(np.concatenate([new, [True]]))]
            ids = block.column(block.schema.get_field_index(id_col)).to_pylist()
            best: dict[tuple, tuple] = {}
            k = 0
            while k < len(heads):
                i, cells, group = item[heads[k]], 0, []
                wanted = item_words[item_first[i] : item_first[i + 1]]
                while k < len(heads) and item[heads[k]] == i and (not group or cells < 1 << 18):
                    group.append(k)
                    cells += int(ends[k] - start[heads[k]])
                    k += 1
                group.sort(key=lambda g: ends[g] - start[heads[g]])
                while group:  # windows of like length share a matrix
                    long = ends[group[-1]] - start[heads[group[-1]]]
                    part = [g for g in group if 2 * (ends[g] - start[heads[g]]) >= long]
                    group = [g for g in group if 2 * (ends[g] - start[heads[g]]) < long]
                    for g, (score, a, b) in zip(part, align(wanted, [words.hash[start[heads[g]] : ends[g]] for g in part]), strict=True):
                        if passes(score, len(wanted)):
                            d = int(doc[heads[g]])
                            base = int(start[heads[g]] - words.first[d])
                            best[d, i] = max(best.get((d, i), (0,)), (score, -(base + a), base + b))
            if best:
                rows = [(ids[d], item_ids[i], s, s / (MATCH * int(item_first[i + 1] - item_first[i])), -a, b, hashlib.md5(raw[d]).digest()) for (d, i), (s, a, b) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PAIR.values(), strict=True)], names=list(_PAIR))

    return run


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """(item ids, item words, first word of each) in blocks of a bounded number of words."""
    ids: list[int] = []
    raw: list[bytes] = []
    n = 0
    for r in benchmark.select(F.col(item_col).cast("long"), text_col).toLocalIterator():
        ids.append(r[0])
        raw.append((r[1] or "").encode())
        n += len(raw[-1]) // 2 + 1
        if n >= BLOCK_ITEM_WORDS:
            yield ids, raw
            ids, raw, n = [], [], 0
    if ids:
        yield ids, raw


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, similarity, start_word, stop_word): the best alignment of every document and item that
    pass LEAST_SHARE and LEAST_WORDS; words count from 0, as words_of cuts them."""
    return _leaks(docs, benchmark, id_col, text_col, item_col, item_text).drop("c")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """leaks and c, the content of the document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, score long, similarity double, start_word long, stop_word long, c binary"
    out = spark.createDataFrame([], schema)
    for ids, raw in _item_blocks(benchmark, item_col, item_text):
        words = words_of(raw)
        grams, sizes = pairs(words), np.diff(words.first)
        item = np.repeat(np.arange(len(ids)), sizes)
        used = np.flatnonzero((grams != 0) & (sizes[item] >= LEAST_ITEM))
        known, number = np.unique(grams[used], return_inverse=True)
        count = np.zeros(len(known), dtype=np.int64)
        counted = docs.mapInArrow(lean(_count(spark.sparkContext.broadcast(known), "text")), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        for r in counted.collect():  # as many rows as the block has pairs
            count[r["gram"]] = r["n"]
        # the most frequent pairs first, so the rank says how many of the item's come before
        order = np.lexsort((-count[number], item[used]))
        rank = np.empty(len(used), np.int64)
        owner = item[used][order]
        rank[order] = np.arange(len(used)) - np.searchsorted(owner, np.arange(len(ids)))[owner]
        sure = sure_pairs(sizes)[item[used]]
        kept = (rank >= sure - np.minimum(sure, TOGETHER)) & (count[number] > 0)
        # of a seed: the items that have it, once for each place
        by_seed = np.flatnonzero(kept)[np.argsort(number[kept], kind="stable")]
        seeds, counts = np.unique(number[by_seed], return_counts=True)
        first = np.concatenate([[0], np.cumsum(counts)])
        held = spark.sparkContext.broadcast((known[seeds], first, item[used][by_seed], ids, words.hash, words.first))
        out = out.unionByName(docs.mapInArrow(lean(_search(held, "doc_id", "text")), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a copy of a benchmark item, by id and content."""
    found = _leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leaked"), F.col("c").alias("_c")).distinct()
    return without(docs, found, (content(F.col(text_col)) == F.col("_c")) & F.col(id_col).cast("long").eqNullSafe(F.col("_leaked")))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a copy."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
