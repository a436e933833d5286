"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with every language of the corpus: its histogram over character classes and its histogram over
the language's most common words (with one bin for all others) against those of all documents of that language, by
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). The nearest language counts. Short documents
give rough histograms, so each distance is used only from a minimum length on. Plain counts (base_failed) come first.

References are exact sums over all documents. Common words are found without shuffling the vocabulary: words are first
counted in BINS hash bins per language (a bounded aggregate in every task), then exactly within the heaviest bins; the
list is proved complete when its last word is at least as frequent as the heaviest bin that was left out, and the bins
are widened until it is. Only the references (COMMON_WORDS words and seven class counts per language) go to the driver
and into the plan, as one constant that every document's few distinct common words are looked up in, so the plan is the
same for any number of languages. Documents are never shuffled.

Null text counts as empty; a null language has no reference; a language with fewer than LEAST_REFERENCE words has none
either; without any reference only the base rules decide. Repeated rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of

COMMON_WORDS = 16
CHAR_WORDS, CHAR_DISTANCE = 50, 0.30
WORD_WORDS, WORD_DISTANCE = 100, 0.33
LEAST_REFERENCE = 1000
BINS = 1 << 12
#: lower case, upper case, digits, white space, full stop and comma, other ASCII, the rest
CLASSES = ("lower", "upper", "digit", "space", "stop", "other_ascii", "beyond_ascii")
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")

_SPACE = r"[\x20\x09-\x0D]+"
_TRIM = r"trim(BOTH ' \t\n\u000B\u000C\r' FROM {0})"


def words_of(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the array of words, empty if there are none; the trimmed text is a column, as both branches read it."""
    df = df.withColumn("_trimmed", F.expr(_TRIM.format(text)))
    return df.withColumn(name, F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", _SPACE))).drop("_trimmed")


def class_counts(df: DataFrame, text: str) -> DataFrame:
    """df with array<long> _classes in the order of CLASSES; each count is what a pass takes out of what the last left."""
    left, counts = text, []
    for i, pattern in enumerate(("[a-z]+", "[A-Z]+", "[0-9]+", _SPACE, "[.,]+", r"[\x00-\x7F]+")):
        df = df.withColumn(f"_left{i}", F.regexp_replace(left, pattern, ""))
        counts.append(F.char_length(F.col(left)) - F.char_length(F.col(f"_left{i}")))
        left = f"_left{i}"
    counts.append(F.char_length(F.col(left)))
    return df.withColumn("_classes", F.array(*(c.cast("long") for c in counts))).drop(*(f"_left{i}" for i in range(6)))


def base_counts(df: DataFrame) -> DataFrame:
    """df (with _text and _words) with the counts that need no reference."""
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # a 64-bit hash stands for the five words of a window; only documents that have an equal pair sort their windows
    window = "transform(sequence(0, n_words - 5), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))"
    df = df.withColumn("_windows", F.expr(f"CASE WHEN n_words >= 5 THEN {window} END"))
    df = df.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END"))
    pairs = "filter(zip_with(_sorted, slice(_sorted, 2, size(_sorted)), (a, b) -> struct(a, b)), z -> z.a.h = z.b.h)"
    df = df.withColumn("_starts", F.expr(f"sort_array(array_distinct(flatten(transform({pairs}, z -> array(z.a.i, z.b.i)))))"))
    steps = "zip_with(_starts, slice(_starts, 2, size(_starts)), (a, b) -> least(5, coalesce(b - a, 5)))"
    df = df.withColumn("n_repeat_words", F.expr(f"CASE WHEN size(_starts) > 0 THEN aggregate({steps}, 0L, (s, x) -> s + x) ELSE 0L END"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.drop("_lines", "_windows", "_sorted", "_starts")


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[str], list[float], list[float]]]:
    """(language, common words, their shares and that of all others, shares of CLASSES) of each language, over all rows."""
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    df = docs.where(lang.isNotNull()).select(lang.alias("_lang"), F.coalesce(text, F.lit("")).alias("_text"))
    classes = class_counts(df, "_text").groupBy("_lang").agg(*(F.sum(F.col("_classes")[i]).alias(c) for i, c in enumerate(CLASSES)))
    words = words_of(df, "_text", "_words").select("_lang", F.explode("_words").alias("_word")).select("_lang", F.lower("_word").alias("_word"))
    words = words.withColumn("_bin", F.pmod(F.xxhash64("_word"), F.lit(BINS)).cast("int"))
    bins: dict[str, list] = {}
    for r in words.groupBy("_lang", "_bin").count().collect():  # at most BINS rows a language
        bins.setdefault(r["_lang"], []).append((r["count"], r["_bin"]))
    totals = {lang: sum(n for n, _ in b) for lang, b in bins.items()}
    bins = {lang: sorted(b, reverse=True) for lang, b in bins.items() if totals[lang] >= LEAST_REFERENCE}
    top: dict[str, list] = {}
    take = 4 * COMMON_WORDS
    while open_ := {lang: b for lang, b in bins.items() if lang not in top}:
        keep = F.lit(False)
        for lang, b in open_.items():
            keep = keep | ((F.col("_lang") == lang) & F.col("_bin").isin([x for _, x in b[:take]]))
        counted = words.where(keep).groupBy("_lang", "_word").count()
        # each task keeps the best of its part before the rows of a language meet
        from pyspark.sql import Window

        best = Window.partitionBy("_lang").orderBy(F.desc("count"), "_word")
        found: dict[str, list] = {}
        for r in counted.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= COMMON_WORDS).collect():
            found.setdefault(r["_lang"], []).append((-r["count"], r["_word"]))
        for lang, b in open_.items():
            best_words = sorted(found.get(lang, []))
            left_out = b[take][0] if len(b) > take else 0
            if left_out == 0 or len(best_words) == COMMON_WORDS and -best_words[-1][0] > left_out:
                top[lang] = best_words
        take *= 4
    out = []
    for r in sorted(classes.collect(), key=lambda r: r["_lang"]):
        if (lang := r["_lang"]) in top:
            shares = [-n / totals[lang] for n, _ in top[lang]]
            chars = sum(r[c] for c in CLASSES)
            out.append((lang, [w for _, w in top[lang]], [*shares, 1 - sum(shares)], [r[c] / chars for c in CLASSES]))
    return out


_REFS = "array<struct<q:array<double>,rest:double,classes:array<double>>>"


def _table(refs: list) -> tuple[list[str], Column]:
    """(all common words, a constant with an entry per language: share of each word in it, of all others, of CLASSES)."""
    vocabulary = sorted({w for _, words, _, _ in refs for w in words})
    at = {w: i for i, w in enumerate(vocabulary)}
    rows = []
    for _, words, shares, classes in refs:
        q = [0.0] * len(vocabulary)
        for w, x in zip(words, shares, strict=False):
            q[at[w]] = x
        rows.append({"q": q, "rest": shares[-1], "classes": classes})
    return vocabulary, F.from_json(F.lit(json.dumps(rows)), _REFS)


def _half(a: Column, b: Column) -> Column:
    """What a bin adds to the divergence of a from the mean of a and b, in bits, twice."""
    return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))


def _distance(terms: Column, rest: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), (F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) + rest) / 2))


def _runs(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """df with _runs, array of (i, p): the place in vocabulary and the share of each common word that a text has."""
    df = df.withColumn("_common", F.sort_array(F.filter(F.transform("_words", F.lower), lambda w: w.isin(vocabulary))))
    df = df.withColumn("_bounds", F.expr("CASE WHEN size(_common) > 0 THEN filter(sequence(0, size(_common) - 1), j -> j = 0 OR _common[j] != _common[j - 1]) ELSE array() END"))
    df = df.withColumn("_counts", F.expr("zip_with(_bounds, slice(_bounds, 2, size(_common)), (a, b) -> coalesce(b, size(_common)) - a)"))
    places = F.transform("_bounds", lambda j: F.array_position(F.array(*map(F.lit, vocabulary)), F.get("_common", j)).cast("int") - 1)
    return df.withColumn("_runs", F.zip_with(places, "_counts", lambda i, n: F.struct(i.alias("i"), (n / F.col("n_words")).alias("p")))).drop("_common", "_bounds", "_counts")


def _judged(docs: DataFrame, text_col: str, lang_col: str, refs: list | None) -> DataFrame:
    """_row, all of a row of docs, and the columns NEW."""
    refs = references(docs, text_col, lang_col) if refs is None else refs
    df = docs.select(F.struct(*columns_of(docs)).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    df = class_counts(base_counts(words_of(df, "_text", "_words")), "_text")
    if refs:
        vocabulary, table = _table(refs)
        df = _runs(df, vocabulary).withColumn("_refs", table)
        df = df.withColumn("_chars", F.greatest(F.aggregate("_classes", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1)))
        df = df.withColumn("_shares", F.transform("_classes", lambda x: x / F.col("_chars")))

        def by_char(ref: Column) -> Column:
            return _distance(F.zip_with("_shares", ref.classes, lambda p, q: _half(p, q) + _half(q, p)), F.lit(0.0))

        def by_word(ref: Column) -> Column:
            own = F.filter("_runs", lambda r: F.get(ref.q, r.i) > 0)
            # words of the language that the text lacks add their share; all words outside it are one bin
            terms = F.transform(own, lambda r: _half(r.p, F.get(ref.q, r.i)) + _half(F.get(ref.q, r.i), r.p) - F.get(ref.q, r.i))
            rest = F.greatest(F.lit(0.0), F.aggregate(own, F.lit(1.0), lambda s, r: s - r.p))
            return _distance(terms, 1 - ref.rest + _half(rest, ref.rest) + _half(ref.rest, rest))

        df = df.withColumn("char_distance", F.array_min(F.transform("_refs", by_char))).withColumn("word_distance", F.array_min(F.transform("_refs", by_word)))
    else:
        df = df.withColumn("char_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double"))
    strange = (F.col("n_words") >= CHAR_WORDS) & (F.col("char_distance") > CHAR_DISTANCE)
    strange = strange | ((F.col("n_words") >= WORD_WORDS) & (F.col("word_distance") > WORD_DISTANCE))
    df = df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False)))
    return df.select("_row", *NEW)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: list | None = None) -> DataFrame:
    """docs with the columns NEW; kept is false for what the base rules or the divergence reject. Input columns with
    these names are replaced; accepted() keeps them."""
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in NEW]
    return _judged(docs, text_col, lang_col, refs).select(*own, *NEW)


def accepted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all columns of docs.

    The row number is there to keep the optimizer from pushing the filter, and with it a copy of every expression that it
    is made of, below the projections that compute them once."""
    out = _judged(docs, text_col, lang_col, None).withColumn("_at", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rw AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id
), b AS (
  SELECT w.doc_id, lang, words, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rw ON w.doc_id = rw.doc_id
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
), cc AS (
  SELECT doc_id, lang, unnest([
    length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')),
    length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')),
    length(regexp_replace(text, '[^.,]', '', 'g')),
    length(regexp_replace(text, '[a-zA-Z0-9\x20\x09-\x0D.,]|[^\x00-\x7F]', '', 'g')),
    length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))]) AS n, unnest(range(7)) AS k
  FROM f
), lw AS (
  SELECT doc_id, lang, lower(unnest(words)) AS word FROM f
), lc AS (
  SELECT lang, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total
  FROM lw WHERE lang IS NOT NULL GROUP BY lang, word
), top AS (
  SELECT lang, word, n / total AS q FROM lc WHERE total >= 1000
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 16
), qc AS (
  SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cc
  WHERE lang IN (SELECT lang FROM top) GROUP BY lang, k
), pc AS (
  SELECT doc_id, k, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS p FROM cc
), dc AS (
  SELECT doc_id, qc.lang, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM pc JOIN qc ON pc.k = qc.k GROUP BY doc_id, qc.lang
), dw0 AS (
  SELECT lw.doc_id, top.lang, lw.word, count(*) AS n, any_value(q) AS q
  FROM lw JOIN top ON lw.word = top.word GROUP BY lw.doc_id, top.lang, lw.word
), base AS (
  SELECT f.doc_id, top.lang, top.word, top.q, coalesce(dw0.n, 0) / greatest(f.n_words, 1) AS p
  FROM f CROSS JOIN top LEFT JOIN dw0 ON dw0.doc_id = f.doc_id AND dw0.lang = top.lang AND dw0.word = top.word
), pw AS (
  SELECT doc_id, lang, p, q FROM base
  UNION ALL SELECT doc_id, lang, greatest(1 - sum(p), 0), 1 - sum(q) FROM base GROUP BY doc_id, lang
), dw AS (
  SELECT doc_id, lang, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM pw GROUP BY doc_id, lang
), v AS (
  SELECT f.*, (SELECT min(d) FROM dc WHERE dc.doc_id = f.doc_id) AS char_d, (SELECT min(d) FROM dw WHERE dw.doc_id = f.doc_id) AS word_d FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= 50 AND char_d > 0.30 OR n_words >= 100 AND word_d > 0.33, false) AS kept
FROM v
"""
