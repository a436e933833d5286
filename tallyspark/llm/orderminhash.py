"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are runs of non-white characters, A-Z in lower case. A text's k-mers are its runs of SHINGLE words, each labelled
with how often it has occurred before. Each of SKETCHES hash functions takes the PICK least labelled k-mers and keeps
them in text order, so two texts agree on a sketch as often as they share k-mers in the same order: it follows edit
similarity, where plain MinHash ignores order. Texts that share a sketch are candidates; a pair is a link if the edit
distance of their words, computed in a band as wide as the limit allows, is at most 1 - SIMILARITY of the longer one.
Texts that share a share s of their k-mers in order meet in some sketch with probability 1 - (1 - s * s) ** SKETCHES, so
an edited copy of a few words, all of whose k-mers an edit can touch, may be missed. Of pairs with 15 % of their words
replaced, 64 sketches find 0.97 to 1.00, with 18 % 0.91 to 0.99, with 20 % (the limit) 0.83 to 0.93 (40 to 300 words).

Plan. Equal texts are one content from the start (a partial aggregation on a 128-bit digest); only contents have
sketches, and copies are never expanded. A content is a 64-bit number from then on. Contents that share a sketch are a
bucket, found by a partial aggregation and a join back, so a hot bucket meets in no task. Members are compared with the
bucket's leader, its least number, so a group of n copies costs about n comparisons, not n * n, and its links are a star.
The links to leaders make first classes. Where the members of a bucket are of more than one class, they meet in a group:
all pairs of two classes that have enough words in common are compared, so the classes are those of all pairs that share
a sketch. A passage that many texts have makes large buckets of texts that are otherwise different: the members of all
buckets of more than MOST_TOGETHER are grouped by their rare runs of words instead (a prefix filter, see keys_of)
and compared if they share a bucket, which is exact, too; keys that only texts of one class have go no further, and groups
of the same texts are one. What is rare follows from counts among these texts in a table of fixed size. A group's texts
are in one task, a part at a time; texts that are alike but for a passage's worth of words are all that makes it large.
Classes are the connected components of the links (see components).

Texts of used contents are fetched by a join, behind a Bloom filter of fixed size: once it is full, the join moves the
packed texts of all documents, and the result is the same.

Null text counts as empty; empty or equal texts are one class. A text shorter than SHINGLE words has one k-mer, itself.
Null ids take part; a class's id is its least id, null only if it has no other. Repeated rows each get their row. Extra
columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, blocks, bloom_filter, bloom_passes, lean, materialize, mix, texts

SHINGLE = 5
SKETCHES, PICK = 64, 2
SIMILARITY = 0.8
MOST_TOGETHER = 256
#: of so many words, the texts of a group are looked at together; of larger ones, in parts
MOST_WORDS = 1 << 22
#: keys of large groups are runs of so many words; counts of them, by so many bits of their hash
LONGEST, FREQUENCY_BITS = 3, 16
BLOCK_BYTES = 1 << 20
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def numbered(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hashes of each text, each with how often it has come before."""
    order = np.lexsort((hashes, text))  # stable: equal hashes of a text stand in text order
    same = np.concatenate([[False], (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])])
    run = np.arange(len(hashes)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(hashes)))) if len(hashes) else np.zeros(0, np.int64)
    label = np.empty(len(hashes), dtype=U64)
    label[order] = run
    return mix(hashes + label * U64(0xD6E8FEB86659FD93))


def kmers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mers of all texts, first of each text and the total); a text without words has none."""
    n = np.diff(words.first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    start = words.first[text] + np.arange(first[-1]) - first[text]
    out = np.zeros(len(start), dtype=U64)
    for k in range(SHINGLE):
        at = start + k
        inside = at < words.first[text + 1]
        out = out * U64(0x9E3779B97F4A7C15) + np.where(inside, words.hash[np.minimum(at, len(words.hash) - 1)], U64(k + 1)) if len(words.hash) else out
    out = mix(out)
    return numbered(out, text), first


def sketches(raw: list[bytes]) -> np.ndarray:
    """One row of SKETCHES numbers for each text that has words; zeros for others."""
    keys, first = kmers(Words(raw, lower=True))
    out = np.zeros((len(raw), SKETCHES), dtype=U64)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    heads, sizes = first[some], np.diff(first)[some]
    for t in range(SKETCHES):
        seed = mix(np.array([t + 1], dtype=U64) * U64(0xA0761D6478BD642F))[0]
        v = (keys ^ seed) * U64(0xE7037ED1A0B428DB)
        v ^= v >> U64(32)
        v *= U64(0x8EBC6AF09C88C6E3)
        picked = []
        for _ in range(PICK):
            least = np.minimum.reduceat(v, heads)
            at = np.flatnonzero(v == np.repeat(least, sizes))
            owner = np.searchsorted(heads, at, side="right") - 1
            place = np.full(len(some), -1, dtype=np.int64)
            place[owner[::-1]] = at[::-1]
            gone = least == _MOST  # fewer than PICK k-mers
            v[place] = _MOST
            picked.append(np.where(gone, -1, place))
        picked = np.sort(np.stack(picked), axis=0)
        code = np.full(len(some), seed, dtype=U64)
        for p in picked:
            code = mix(code * U64(0x9E3779B97F4A7C15) + np.where(p >= 0, keys[np.maximum(p, 0)], U64(0)))
        out[some, t] = code
    return out


def within(a: list, b: list, limit: int) -> int | None:
    """The edit distance of two sequences if it is at most limit, else None.

    Bit-parallel (Hyyro 2003): bits are the rows of a band of 2 * limit + 1 diagonals that moves down a column at a time.
    """
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    if len(a) > len(b):
        a, b = b, a  # a down the rows, b along the columns
    if len(b) - len(a) > limit:
        return None
    if not a or limit == 0:
        return len(b) if len(b) <= limit else None
    limit = min(limit, len(b))
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    width = 2 * limit + 1
    mask = (1 << width) - 1
    # bit i stands for row j - limit + i of column j (rows and columns from 1)
    up, down = mask & ~((1 << limit) - 1), 0
    low, last, score = limit, len(a), limit  # score: at the band's lowest cell that is a row, here row `limit` of column 0
    if last <= limit:
        score = last
    for j, y in enumerate(b, 1):
        found, shift = rows.get(y, 0), j - limit - 1
        found = (found >> shift if shift >= 0 else found << -shift) & mask
        diagonal = (((found & up) + up) ^ up) | found | down
        plus = down | ~(diagonal | up)
        minus = diagonal & up
        if j + limit <= last:  # the lowest diagonal is still inside
            score += not diagonal >> (2 * limit) & 1
        else:
            bit = last - j + limit
            if bit < 0:
                return None
            score += (plus >> bit & 1) - (minus >> bit & 1)
        shifted = (diagonal & mask) >> 1
        up = (minus | ~(shifted | plus)) & mask
        down = shifted & plus & mask
    return score if score <= limit else None


def similar(a: list, b: list) -> bool:
    limit = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
    return within(a, b, limit) is not None


def split(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).lower().split()


def content(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _sketch(batches):
    for block in blocks(batches, "text", BLOCK_BYTES):
        rows = sketches([t.encode() for t in texts(block, "text")])
        yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([r.astype("<u8").tobytes() if r.any() else None for r in rows], pa.binary())], names=["doc_id", "c", "sketch"])


def _explode(batches):
    """A row for each sketch of a content."""
    for batch in batches:
        own = [(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if y is not None]
        if own:
            keys = np.frombuffer(b"".join(y for _, y in own), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x for x, _ in own], SKETCHES)), pa.array(keys)], names=["num", "key"])


def _compare(batches):
    for batch in batches:
        ok, last, words = [], None, None
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = a.as_py(), b.as_py()
            if b != last:
                last, words = b, split(b)
                bag = Counter(words)
            own = split(a)
            common = sum((Counter(own) & bag).values())  # an edit takes away one word in common at most
            ok.append(common >= SIMILARITY * max(len(own), len(words)) - 1e-9 and similar(own, words))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "ok"])


def _coded(batches, column: str, longest: int = 1):
    """(batch, [(numbered hashes of all runs of k neighbouring words, first of each text and the total) for k up to
    longest]) for some rows at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            words = Words([zstandard.decompress(b) for b in batch.column(batch.schema.get_field_index(column)).to_pylist()], lower=True)
            n, levels = np.diff(words.first), []
            for k in range(1, longest + 1):
                count = np.maximum(n - k + 1, 0)
                first = np.concatenate([[0], np.cumsum(count)])
                text = np.repeat(np.arange(len(n)), count)
                at = words.first[text] + np.arange(first[-1]) - first[text]
                code = np.zeros(len(at), dtype=U64)
                for j in range(k):
                    code = mix(code * U64(0xA0761D6478BD642F) + words.hash[at + j])
                levels.append((numbered(code, text), first))
            yield batch, levels


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> U64(64 - FREQUENCY_BITS)).astype(np.int64)


def _frequency(batches):
    """Counts of words, of word pairs and of triples, one after another, by slot."""
    size = 1 << FREQUENCY_BITS
    total = np.zeros(LONGEST * size, dtype=np.int64)
    for _, levels in _coded(batches, "body", LONGEST):
        for k, (codes, _) in enumerate(levels):
            total[k * size : (k + 1) * size] += np.bincount(_slot(codes), minlength=size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def keys_of(levels: list[np.ndarray], frequency: np.ndarray) -> np.ndarray:
    """Keys of which any two texts within the limit share one at least; levels are the codes of a text's runs of 1, 2, ...
    words.

    An edit takes away k runs of k words at most. So texts of n and m words within the limit, m >= n, have in common
    m - k + 1 - k * (1 - SIMILARITY) * m runs, and if this is one or more they share one of their first runs in an order that
    holds for all texts, where a text's first ones are all but so many less one. Long runs are rarer and make smaller
    groups, unless much of a text is what many texts have. So a text has its first runs of LONGEST words but for frequent
    ones. If there are such, or it is too short, it has its first runs of one word less, too, as has any text with which it
    shares only these, and so on down to words, all of whose first ones count."""
    n, out = len(levels[0]), []
    for k in range(len(levels), 0, -1):
        codes, known = levels[k - 1], frequency[(k - 1) << FREQUENCY_BITS : k << FREQUENCY_BITS]
        common = int(np.ceil(n - k + 1 - k * (1 - SIMILARITY) * n - 1e-9))
        first = codes[np.lexsort((codes, known[_slot(codes)]))[: max(len(codes) - max(common, 1) + 1, 0)]]
        frequent = known[_slot(first)] > max(MOST_TOGETHER, 8 * int(known.mean()))
        out.append(mix((first if k == 1 else first[~frequent]) ^ U64(k)))
        # a text of at most 1 / SIMILARITY times the words may have no run in common
        if k == 1 or common > 1 and not frequent.any() and int(n * SIMILARITY) * (1 - k * (1 - SIMILARITY)) - k + 1 > 1e-9:
            break
    return np.concatenate(out)


def _keys_of_all(levels: list, frequency: np.ndarray) -> list[np.ndarray]:
    return [keys_of([codes[first[i] : first[i + 1]] for codes, first in levels], frequency) for i in range(len(levels[0][1]) - 1)]


def _prefixes(held):
    """A row (key, num, label) for each of the keys of rows (num, label, body)."""

    def run(batches):
        for batch, levels in _coded(batches, "body", LONGEST):
            heads = _keys_of_all(levels, held.value)
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(h) for h in heads]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row)], names=["key", "num", "label"])

    return run


class Forest:
    """Union-find over what comes."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b) -> bool:
        """False if a and b are connected already."""
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a
        return a != b


class Postings:
    """For each code the texts that have it."""

    def __init__(self, codes: list[np.ndarray]):
        sizes = np.array([len(c) for c in codes])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        _, self.code = np.unique(np.concatenate(codes), return_inverse=True)
        self.texts = np.repeat(np.arange(len(codes)), sizes)[np.argsort(self.code, kind="stable")]
        self.count = np.bincount(self.code)
        self.begin = np.cumsum(self.count) - self.count

    def common(self, k: int) -> np.ndarray:
        """How many codes each text has in common with text k."""
        own = self.code[self.first[k] : self.first[k + 1]]
        n = self.count[own]
        at = np.repeat(self.begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.texts[at], minlength=len(self.first) - 1)


class Group:
    """Texts that share a key, with their labels: what each is known to be connected with. Of a group that is a part of
    larger ones (frequency is given), a pair is compared only in the group of the least key that both texts have."""

    def __init__(self, key: int, frequency: np.ndarray | None = None):
        self.key, self.frequency = U64(key % (1 << 64)), frequency
        self.labels, self.bodies, self.codes, self.buckets = [], [], [], []

    def add(self, label: int, body: bytes, codes: np.ndarray, buckets: frozenset | None) -> None:
        """buckets: those that the text is in, if not all of the group are in one."""
        for held, x in zip((self.labels, self.bodies, self.codes, self.buckets), (label, body, codes, buckets), strict=True):
            held.append(x)

    def links(self) -> list[tuple[int, int]]:
        """Links between labels. Of labels that are connected already, texts are not compared."""
        forest, size = Forest(), np.cumsum([len(c) for c in self.codes])
        if len(set(self.labels)) < 2:
            return []
        if size[-1] <= MOST_WORDS:
            return self._among(range(len(self.labels)), forest)
        # a part with every other one, so memory is bounded
        part = (size // (MOST_WORDS // 2)).tolist()
        parts = [[i for i, p in enumerate(part) if p == k] for k in dict.fromkeys(part)]
        return [x for a, first in enumerate(parts) for second in parts[a + 1 :] for x in self._among([*first, *second], forest)]

    def _among(self, members, forest: Forest) -> list[tuple[int, int]]:
        """All texts but those of the most frequent label look for their like by the words in common with all others, which
        are counted by the lists of the texts that have each word."""
        members, found = np.array(members), []
        roots = [forest.root(self.labels[i]) for i in members]
        most = Counter(roots).most_common(1)[0][0]
        sizes = np.array([len(self.codes[i]) for i in members])
        words = Postings([self.codes[i] for i in members])
        lesser = Postings(self._lesser(members)) if self.frequency is not None else None
        rest = np.array([r != most for r in roots])
        wanted = []
        for k in np.flatnonzero(rest):
            common = words.common(k)  # an edit takes away one word in common at most
            if lesser:
                common[lesser.common(k) > 0] = 0
            near = np.flatnonzero((common >= SIMILARITY * np.maximum(sizes, sizes[k]) - 1e-9) & (~rest | (np.arange(len(members)) < k)))
            wanted += [(members[k], members[j]) for j in near[np.argsort(-common[near], kind="stable")]]
            if len(wanted) > 100_000:
                found += self._compared(wanted, forest)
                wanted = []
        return found + self._compared(wanted, forest)

    def _lesser(self, members) -> list[np.ndarray]:
        """The keys of each text that are less than the group's."""
        out = []
        for i in range(0, len(members), 256):
            batch = pa.RecordBatch.from_arrays([pa.array([self.bodies[m] for m in members[i : i + 256]], pa.binary())], names=["body"])
            out += [k[k < self.key] for _, levels in _coded([batch], "body", LONGEST) for k in _keys_of_all(levels, self.frequency)]
        return out

    def _compared(self, wanted: list[tuple[int, int]], forest: Forest) -> list[tuple[int, int]]:
        def open_(a, b):
            return forest.root(self.labels[a]) != forest.root(self.labels[b]) and not (self.buckets[a] and self.buckets[b] and self.buckets[a].isdisjoint(self.buckets[b]))

        wanted, found, last, words = [p for p in wanted if open_(*p)], [], None, None
        for a, b in wanted:
            if open_(a, b):
                if a != last:
                    last, words = a, split(self.bodies[a])
                if similar(split(self.bodies[b]), words):
                    forest.join(self.labels[a], self.labels[b])
                    found.append((self.labels[b], self.labels[a]))
        return found


def _join_groups(held):
    """Links between labels, from rows (key, label, body, buckets) that come by key."""

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    def run(batches):
        at, group = None, None
        for batch, [(codes, first)] in _coded(batches, "body"):
            for i, (key, label, body, buckets) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if key != at:
                    if group and (found := group.links()):
                        yield batch_of(found)
                    at, group = key, Group(key, held.value if buckets else None)
                group.add(label, body, codes[first[i] : first[i + 1]], frozenset(buckets) if buckets else None)
        if group and (found := group.links()):
            yield batch_of(found)

    return run


def _several(rows: DataFrame) -> DataFrame:
    """(key, n) of the groups of rows (key, num, label) that have two labels; of groups of the same texts, the one of the
    least key by its 64 bits without a sign."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "num")).alias(f"m{k}") for k in range(2)]
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), *marks, F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
    return groups.groupBy("n", "m0", "m1").agg(F.min(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).alias("key")).select(F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("key"), "n")


def _among(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of rows (key, num, label): all that texts of one key and of two labels make."""
    spark = rows.sparkSession
    rows = materialize(rows.join(_several(rows), "key"))
    used = materialize(bodies.join(rows.select("num").distinct(), "num", "left_semi"))
    frequency = np.zeros(LONGEST << FREQUENCY_BITS, dtype=np.int32)
    for r in used.select("body").mapInArrow(lean(_frequency), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        frequency[r["slot"]] = min(r["n"], 2**31 - 1)
    held = spark.sparkContext.broadcast(frequency)
    near = rows.where(F.col("n") <= MOST_TOGETHER).select("key", "num", "label", F.lit(False).alias("parted"))
    large = materialize(rows.where(F.col("n") > MOST_TOGETHER).groupBy("num", "label").agg(F.collect_set("key").alias("buckets")))
    texts_ = used.join(large.select("num", "buckets"), "num", "left")
    if large.limit(1).count():
        parts = used.join(large, "num").select("num", "label", "body").mapInArrow(lean(_prefixes(held)), "key long, num long, label long")
        parts = materialize(parts)
        near = near.unionByName(parts.join(_several(parts).select("key"), "key").withColumn("parted", F.lit(True)))
    near = near.join(texts_, "num").select("key", "label", "body", F.when(F.col("parted"), F.col("buckets")).alias("buckets"), "num")
    return near.repartition(F.col("key")).sortWithinPartitions("key", "label", "num").drop("num").mapInArrow(lean(_join_groups(held)), "a long, b long")


def _zip(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zstandard.compress((t or "").encode(), 3) for t in batch.column(2).to_pylist()], pa.binary())], names=["k", "c", "body"])


def _bodies(docs: DataFrame, contents: DataFrame, used: DataFrame) -> DataFrame:
    """(num, body): the packed texts of the contents in used (num)."""
    used = materialize(contents.join(used, "num", "left_semi").select(F.xxhash64("c", "rep_id").alias("k"), "c", "num"))
    words, n = bloom_filter(used, F.col("k"))
    near = bloom_passes(docs.select(F.xxhash64("c", "doc_id").alias("k"), "c", "text"), words, n, F.col("k"))
    # one row of those that repeat both id and text; the join has dealt them by the same columns
    return materialize(near.mapInArrow(lean(_zip), "k long, c binary, body binary").join(used, ["k", "c"]).dropDuplicates(["k", "c"]).select("num", "body"))


def classes(docs: DataFrame) -> DataFrame:
    """(c, class, class_id, class_size) of the contents of docs (doc_id, c, text)."""
    rows = docs.select("doc_id", "c", "text").mapInArrow(lean(_sketch), "doc_id long, c binary, sketch binary")
    contents = rows.groupBy("c").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n"), F.first("sketch").alias("sketch"))
    # a content's number is fixed once it is written
    contents = materialize(contents.withColumn("num", F.monotonically_increasing_id()))
    members = contents.select("num", "sketch").mapInArrow(lean(_explode), "num long, key long")
    leaders = members.groupBy("key").agg(F.min("num").alias("leader"), F.max("num").alias("last")).where("leader != last").select("key", "leader")
    pairs = materialize(members.join(leaders, "key").select("key", "num", "leader"))
    wanted = materialize(pairs.where("num != leader").select(F.col("num").alias("member"), "leader").distinct())
    bodies = _bodies(docs, contents, wanted.select(F.explode(F.array("member", "leader")).alias("num")).distinct())
    two = wanted.join(bodies.select(F.col("num").alias("member"), F.col("body").alias("body_a")), "member")
    two = two.join(bodies.select(F.col("num").alias("leader"), F.col("body").alias("body_b")), "leader")
    checked = two.select(F.col("member").alias("a"), F.col("leader").alias("b"), "body_a", "body_b").mapInArrow(lean(_compare), "a long, b long, ok boolean")
    first = components(checked.where("ok").select("a", "b"))
    # the members of a bucket that are not of one class already meet; all have met the leader
    rows = pairs.select("key", "num").join(first, "num", "left").select("key", "num", F.coalesce("label", "num").alias("label"))
    again = components(_among(materialize(rows), bodies)).select(F.col("num").alias("first"), F.col("label").alias("final"))
    # contents that no other one is linked with aren't in any link
    linked = first.select("num", F.col("label").alias("first")).unionByName(again.join(first, F.col("first") == F.col("num"), "left_anti").select(F.col("first").alias("num"), "first"))
    linked = linked.join(again, "first", "left").select("num", F.coalesce("final", "first").alias("class"))
    linked = materialize(linked.join(contents.select("num", "rep_id", "n"), "num"))
    sizes = linked.groupBy("class").agg(F.min("rep_id").alias("class_id"), F.sum("n").alias("class_size"))
    known = linked.select("num", "class").join(sizes, "class")
    return contents.select("c", "rep_id", "n", "num").join(known, "num", "left").select(
        "c", F.coalesce("class", "num").alias("class"), F.when(F.col("class").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", "n").alias("class_size")
    )


def _forest(batches):
    """Of the edges of a task, those that connect what the ones before have not."""
    forest = Forest()
    for batch in batches:
        own = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if forest.join(a, b)]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*own, strict=True)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(num, label): the least node of the component of each node of edges (a, b).

    Each round drops the edges that a task finds to be closing a circle, lets every node point to its least neighbour or
    itself and goes on with the edges between those that are pointed to, so that a star is gone after one round. What
    nodes point to is then looked up from the last round to the first."""
    spark, rounds = edges.sparkSession, []
    while True:
        edges = materialize(edges.mapInArrow(lean(_forest), "a long, b long"))
        if edges.limit(1).count() == 0:
            break
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(ends.groupBy(F.col("a").alias("num")).agg(F.min("b").alias("b")).select("num", F.least("num", "b").alias("label")))
        rounds.append(to)
        edges = edges.join(to.select(F.col("num").alias("a"), F.col("label").alias("to_a")), "a").join(to.select(F.col("num").alias("b"), F.col("label").alias("to_b")), "b")
        edges = edges.where("to_a != to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    if not rounds:
        return spark.createDataFrame([], "num long, label long")
    labels = rounds.pop()
    while rounds:
        far = labels.select(F.col("num").alias("label"), F.col("label").alias("far"))
        labels = rounds.pop().join(far, "label", "left").select("num", F.coalesce("far", "label").alias("label"))
    return materialize(labels)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, c (its content), class (the class's number), class_id (its least id), class_size."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("c", content(F.col("text")))
    return docs.select("doc_id", "c").join(classes(docs), "c").select("doc_id", "c", "class", "class_id", "class_size")


def op4_order_minhash(spark, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document; class_id is the least doc_id of the class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
