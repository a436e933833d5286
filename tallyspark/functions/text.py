"""Steps that clean a model's free text and align it with a vocabulary, as Column builders.

Vocabularies are plain lists known when the plan is made; they become literal arrays, so alignment is a projection
without join or shuffle. Behaviour follows the documented decisions: ties in distance go to the least label, in buckets
to the smaller value, among substrings to the longest label and then to vocabulary order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import strip

EOS = "<|end_of_text|>"

# --- fixed values -----------------------------------------------------------------------------------------------------
STOP_WORDS = ("a", "an", "the", "definitely", "probably", "likely", "maybe", "it", "is", "sounds", "sound", "like", "detected", "detect", "i", "hear", "hearing")
MCQ_MARKERS = (
    r"(?:^|\b)(?:final\s+answer|answer|correct\s+(?:option|choice|description)|selected\s+option|i\s+choose|i\s+pick)\s*(?:is|:|-)?\s*(?:option\s*)?[*_`\(\[]*([a-z])\b",
    r"(?:^|\b)(?:the\s+)?(?:correct|best)\s+(?:match|option|choice|description)\s*(?:is|:|-)\s*[*_`\(\[]*([a-z])\b",
    r"(?:^|\b)[*_`\(\[]*([a-z])\b[*_`\)\]]*\s*$",
)
MCQ_OPTION = r"\b(?:option|choice|description)\s*([A-Z])\b"
MCQ_ALONE = r"(?<![0-9A-Za-z_])([A-Z])(?![0-9A-Za-z_])"
MCQ_WRAPPING = r"""^[\s\*\_`\(\[\{<]+|[\s\*\_`\)\]\}>\.!\?:;,'"]+$"""
NUMBER = r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
HZ_LABEL = r"^\s*(\d+)\s*hz\s*$"
HZ_RANGE = r"(\d{3,6})\s*-\s*(\d{3,6})\s*hz\b"
TIME_PREFIX = r"^\s*#?\s*\d+(?:\.\d+)?\s*s?\s*-\s*\d+(?:\.\d+)?\s*s?\s*#?\s*:\s*"
# ----------------------------------------------------------------------------------------------------------------------
#: case-insensitive, lines end at \n only, classes in the Unicode sense
_FLAGS = "(?imdU)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lits(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def lowered(labels: list[str], stripped: bool = False) -> dict[str, str]:
    """Lower-cased label to the label as first seen."""
    out: dict[str, str] = {}
    for label in labels:
        label = label.strip() if stripped else label
        if label.lower() or not stripped:
            out.setdefault(label.lower(), label)
    if not out:
        raise ValueError("labels must be a non-empty sequence")
    return out


def parse_labels(text: Column, separator: str = ",", keep_empty: bool = False) -> Column:
    """Stripped parts of a text; a comma between two digits doesn't part them."""
    pattern = r"(?<![0-9]),|,(?![0-9])" if separator == "," else re.escape(separator).replace(r"\ ", " ")
    parts = F.transform(F.split(text, pattern), strip)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def normalize_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_eos(s: Column, eos: str = EOS) -> Column:
    return F.substring_index(s, eos, 1)


def nearest(s: Column, labels: list[str]) -> Column:
    """struct(d, l): the least edit distance to a label, and the least such label."""
    return F.array_min(F.transform(lits(sorted(set(labels))), lambda x: F.struct(F.levenshtein(s, x).alias("d"), x.alias("l"))))


def fuzzy_match(s: Column, labels: list[str], max_distance: int | None = None, default: str = "None") -> Column:
    """The nearest label, case-sensitive; with max_distance the default for what is farther."""
    if not labels:
        raise ValueError("labels must be a non-empty sequence")
    best = nearest(s, labels)
    if max_distance is None:
        return best["l"]
    return let(best, lambda b: F.when(b["d"] > max_distance, F.lit(default)).otherwise(b["l"]))


def _named(low: Column, names: dict[str, str]) -> Column:
    """The label of a lower-cased one, else null."""
    return F.get(lits(list(names.values())), F.array_position(lits(list(names)), low).cast("int") - 1)


def _contained(low: Column, names: dict[str, str]) -> Column:
    """The longest label that the text contains; one of up to two characters needs something else around it."""
    by_length = sorted(names, key=lambda x: -len(x))
    long = F.get(F.filter(lits([x for x in by_length if len(x) > 2]), lambda x: F.contains(low, x)), F.lit(0))
    out = [_named(long, names)]
    for x in by_length:
        if len(x) <= 2:
            quoted = re.sub(r"([^0-9a-zA-Z])", r"\\\1", x)
            out.append(F.when(low.rlike(rf"(?<![0-9a-z_]){quoted}(?![0-9a-z_])"), F.lit(names[x])))
    return F.coalesce(*out)


def extract_label(s: Column, labels: list[str], max_distance: int | None = None, default: str = "None") -> Column:
    """A label by exact match, else the longest one contained, else the nearest; case is ignored."""
    names = lowered(labels)

    def of(low: Column) -> Column:
        best = nearest(low, list(names))
        far = _named(best["l"], names) if max_distance is None else let(best, lambda b: F.when(b["d"] > max_distance, F.lit(default)).otherwise(_named(b["l"], names)))
        return F.coalesce(_named(low, names), _contained(low, names), far)

    return let(strip(F.lower(s)), of)


def conservative_match(s: Column, labels: list[str], max_distance: int = 2, allow_fuzzy: bool = True, drop_unmatched: bool = True) -> Column:
    """A label by exact match of the core phrase, containment, or a small distance; null for what is to be dropped."""
    names = lowered(labels, stripped=True)
    lead = rf"^(?:(?:{'|'.join(STOP_WORDS)}) )+(?=\S)"

    def of(core: Column) -> Column:
        found = [_named(core, names), _contained(core, names)]
        if allow_fuzzy:
            found.append(let(nearest(core, list(names)), lambda b: F.when(b["d"] <= max_distance, _named(b["l"], names))))
        if not drop_unmatched:
            found.append(strip(s))
        return F.coalesce(*found)

    core = F.regexp_replace(normalize_whitespace(F.regexp_replace(F.lower(strip(s)), r"(?U)[^0-9a-z_\s\-]", " ")), lead, "")
    return F.when(strip(s) != "", let(core, of))


def extract_choice(s: Column, labels: list[str]) -> Column:
    """The letter that an answer to a multiple-choice question names last."""
    names = lowered([str(x) for x in labels])
    letters = [x for x in names if len(x) == 1 and x.isalpha()]
    last = lambda pattern: _named(F.try_element_at(F.filter(F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), F.lower), lambda x: x.isin(list(names))), F.lit(-1)), names)
    core = F.lower(F.regexp_replace(strip(s), "(?U)" + MCQ_WRAPPING, ""))
    short = F.when(core.isin(letters), _named(core, names)) if letters else F.lit(None).cast("string")
    return F.coalesce(short, *(last(_FLAGS + p) for p in (*MCQ_MARKERS, MCQ_OPTION)), last("(?m)" + MCQ_ALONE), extract_label(s, list(labels)))


def extract_bucket(s: Column, labels: list[str]) -> Column:
    """The `N Hz` label nearest to the middle of a range in Hz, else to the last number."""
    buckets = sorted(((float(m[1]), x.strip()) for x in labels if (m := re.match(HZ_LABEL, x, re.IGNORECASE))), key=lambda b: b[0])
    if not buckets:
        return extract_label(s, labels)
    table = F.array(*(F.struct(F.lit(hz).alias("hz"), F.lit(i).alias("i")) for i, (hz, _) in enumerate(buckets)))

    def near(v: Column) -> Column:
        place = F.array_min(F.transform(table, lambda b: F.struct(F.abs(v - b["hz"]).alias("d"), b["i"].alias("i"))))["i"]
        return F.when(v.isNotNull(), F.get(lits([x for _, x in buckets]), place))

    a, b = (F.regexp_extract(s, _FLAGS + HZ_RANGE, i).try_cast("double") for i in (1, 2))
    scale = F.when((a >= 1000) & (b >= 1000) & (F.greatest(a, b) <= 50000), 0.1).otherwise(1.0)
    number = F.replace(F.try_element_at(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(1)), F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(let((a + b) / 2 * scale, near), let(number, near), extract_label(s, labels))


def extract_scientific_name(s: Column, labels: list[str], min_score: float = 1.0) -> Column:
    """The label most of whose words the answer has; of equal scores the one of most words; else the stripped answer."""
    if not labels or min_score <= 0:
        raise ValueError("labels must be a non-empty sequence and min_score positive")
    table = F.array(*(F.struct(F.lit(x).alias("l"), lits(x.lower().split()).alias("parts"), F.lit(" ".join(x.lower().split())).alias("phrase"), F.lit(-i).alias("i")) for i, x in enumerate(labels)))

    def of(norm: Column) -> Column:
        def scored(tokens: Column) -> Column:
            def score(x: Column) -> Column:
                hit = F.size(F.filter(x["parts"], lambda p: F.array_contains(tokens, p)))
                n = F.size(x["parts"])
                value = F.when(n > 0, hit / n + F.when(F.contains(norm, x["phrase"]), 0.25).otherwise(0.0)).otherwise(0.0)
                return F.struct(value.alias("score"), n.alias("n"), x["i"].alias("i"), x["l"].alias("l"))

            return F.array_max(F.transform(table, score))

        return let(F.split(norm, " "), scored)

    norm = F.lower(F.regexp_replace(F.regexp_replace(s, _FLAGS + TIME_PREFIX, ""), r"[*_`]", " "))
    norm = normalize_whitespace(F.regexp_replace(norm, r"(?U)[^a-z0-9\s\-\.]", " "))
    return let(let(norm, of), lambda b: F.when(b["score"] >= min_score, b["l"]).otherwise(strip(s)))


def looks_scientific(s: Column) -> Column:
    """At least two words, each of Latin letters, hyphens and full stops."""
    return let(F.split(normalize_whitespace(s), " "), lambda t: (F.size(t) >= 2) & F.forall(t, lambda x: x.rlike(r"^[A-Za-z][A-Za-z\-\.]+$")))


def parse_yes_no(s: Column) -> Column:
    """1.0 or 0.0 for an answer that begins with yes or no; else null."""
    up = F.upper(strip(s))
    return F.when(up.startswith("YES"), F.lit(1.0)).when(up.startswith("NO"), F.lit(0.0))


def safe_name(s: Column) -> Column:
    """A name fit for a folder."""
    return F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_")


#: cleaner names to builders over one segment; a null result drops the segment
CLEANERS: dict[str, Callable[..., Column]] = {
    "normalize_whitespace": normalize_whitespace,
    "strip_eos": strip_eos,
    "fuzzy_match_to_labels": fuzzy_match,
    "extract_label_from_text": extract_label,
    "conservative_match_to_labels": conservative_match,
    "extract_mcq_choice_from_text": extract_choice,
    "extract_hz_bucket_from_text": extract_bucket,
    "extract_scientific_name_from_text": extract_scientific_name,
}
PARSERS: dict[str, Callable[..., Column]] = {"parse_labels_comma": parse_labels}


def _step(table: dict[str, Callable[..., Column]], name: str, args: dict) -> Callable[[Column], Column]:
    return lambda s: table[name](s, **args)


def run_steps(text: Column, parsers=(), cleaners=()) -> Column:
    """struct(segments, text, warnings) after the named steps (name, keyword arguments)."""
    unknown = [n for n, _ in parsers if n not in PARSERS] + [n for n, _ in cleaners if n not in CLEANERS]
    if unknown:
        raise ValueError(f"unknown step: {unknown[0]}")
    segments = F.array(text)
    for name, args in parsers:
        segments = F.flatten(F.transform(segments, _step(PARSERS, name, args)))
    empty = F.size(segments) == 0
    for name, args in cleaners:
        segments = F.filter(F.transform(segments, _step(CLEANERS, name, args)), lambda s: s.isNotNull())
    warned = F.when(empty, F.array(F.lit("no segments after parsing"))).otherwise(F.array().cast("array<string>"))
    return let(segments, lambda s: F.struct(s.alias("segments"), F.array_join(s, ", ").alias("text"), warned.alias("warnings")))
