"""Language identification with a string kernel.

Two texts are as alike as the byte n-grams (1 to LONGEST together, the blended spectrum) that both have: the number of
common ones over the geometric mean of the numbers of distinct ones. fit() draws LANDMARKS texts (Nystroem) and
TRAIN_PER_LANGUAGE rows of every language, by order of a hash of their id, so that any partitioning gives the same
model, and solves one ridge regression per language against the rest on the landmarks' kernel map. Both numbers are
parameters and bound what reaches the driver, but for the length of the drawn texts.

Scoring is linear in the kernel, so landmarks and weights fold into one matrix of n-gram by language; a block of texts
is scored by one product of its presence matrix (sparse, rows of distinct n-grams) with it. Whole texts are read, in
lower case; documents are never shuffled.

A null text, or one without a letter, is `und` with score 0, as is every text if there is no labelled row. Null ids are
not held out; rows with null language or text teach nothing. Repeated rows are kept. Languages may be of any number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, lean

LONGEST = 3
LANDMARKS = 256
TRAIN_PER_LANGUAGE = 300
RIDGE = 1e-2
BLOCK_BYTES = 2 << 20
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted codes of the landmarks' n-grams
    weights: np.ndarray  # (n-grams + 1) x languages; the last row is for all others
    bias: np.ndarray


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): the distinct n-grams of text i are codes[first[i]:first[i + 1]], sorted; none of an empty text."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(raw), dtype=np.uint64) << np.uint64(32), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes up to the end of the text
    keys, code = [], np.zeros(len(data), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | data[n - 1 :]
        inside = left[:m] >= n
        keys.append((doc[:m] | np.uint64(n << 24) | code)[inside])
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    first = np.searchsorted(keys, np.arange(len(raw) + 1, dtype=np.uint64) << np.uint64(32))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), first


def _places(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
    return np.where(grams[at] == codes, at, len(grams))


def solve(rows: list[tuple[str, str]], landmarks: int = LANDMARKS) -> Model | None:
    """rows of (language, text); the first ones of each language become landmarks."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    per, chosen, seen = max(2, landmarks // len(languages)), [], dict.fromkeys(languages, 0)
    for i, (lang, _) in enumerate(rows):
        if seen[lang] < per:
            seen[lang] += 1
            chosen.append(i)
    codes, first = presence([t for _, t in rows])
    size = np.sqrt(np.maximum(np.diff(first), 1))
    grams = np.unique(np.concatenate([codes[first[i] : first[i + 1]] for i in chosen]))
    if not len(grams):
        return None
    held = np.zeros((len(grams) + 1, len(chosen)), dtype=np.float32)
    for k, i in enumerate(chosen):
        held[_places(grams, codes[first[i] : first[i + 1]]), k] = 1 / size[i]
    held[-1] = 0
    kernel = np.stack([held[_places(grams, codes[first[i] : first[i + 1]])].sum(axis=0) / size[i] for i in range(len(rows))]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    own = np.array([languages.index(lang) for lang, _ in rows])
    goal = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(own)[own]  # each language weighs the same
    mean, level = (weight[:, None] * features).sum(0) / weight.sum(), (weight[:, None] * goal).sum(0) / weight.sum()
    x, y = features - mean, goal - level
    beta = np.linalg.solve((x * weight[:, None]).T @ x + RIDGE * np.eye(x.shape[1]), (x * weight[:, None]).T @ y)
    return Model(languages, grams, (held.astype(np.float64) @ (root @ beta)).astype(np.float32), level - mean @ beta)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(language, score from 0 to 1) of each text."""
    real = [t if t and model and _LETTER.search(t) else "" for t in texts]
    if not any(real):
        return ["und"] * len(texts), [0.0] * len(texts)
    codes, first = presence(real)
    rows = model.weights[_places(model.grams, codes)]
    sums = np.zeros((len(real), len(model.languages)))
    some = np.flatnonzero(np.diff(first))
    sums[some] = np.add.reduceat(rows, first[some], axis=0, dtype=np.float64)
    scores = sums / np.sqrt(np.maximum(np.diff(first), 1))[:, None] + model.bias
    best = scores.argmax(axis=1)
    level = np.clip((scores[np.arange(len(real)), best] + 1) / 2, 0, 1)
    return [model.languages[b] if t else "und" for b, t in zip(best, real, strict=True)], [float(s) if t else 0.0 for s, t in zip(level, real, strict=True)]


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = LANDMARKS, per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """A model from at most per_language rows of each language, those of the least hashes of their id and, of one id, of
    the text; repeated rows that are drawn teach once."""
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    order = F.struct(F.xxhash64(F.lit(11), F.col(f"`{id_col}`").cast("string")).alias("id"), F.xxhash64(F.lit(11), text).alias("text"))
    rows = train.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("_lang"), order.alias("_h"), text.alias("_text"))
    # hashes first, without texts: every task keeps its least ones of each language
    drawn = rows.select("_lang", "_h").withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).where(F.col("_rank") <= per_language)
    drawn = F.broadcast(drawn.select("_lang", "_h").distinct())  # at most per_language rows a language
    sample: dict[str, list] = {}
    for r in sorted(rows.join(drawn, ["_lang", "_h"]).dropDuplicates(["_lang", "_h"]).collect(), key=lambda r: (r["_lang"], r["_h"])):
        sample.setdefault(r["_lang"], []).append((r["_lang"], r["_text"]))
    return solve([r for lang in sorted(sample) for r in sample[lang]], landmarks)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row; nothing but the text is read for the prediction."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches, "_text", BLOCK_BYTES):
            lang, score = predict(held.value, block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return picked.mapInArrow(lean(run), f"`{id_col}` long, lang_pred string, score double")


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; of a null id 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor, F.lit(0))


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(remainder("doc_id", 3) != 1))
    out = identify(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
