"""Personal data: every detected entity gets a keyed surrogate of its own type.

One normal form stands for an entity, however it is written: names in capitals or not, phone numbers with or without
blanks and brackets, card numbers and IBANs with or without blanks, addresses in any case. The surrogate belongs to the
normal form and the key alone, so equal entities get equal surrogates in all documents, and it is put out in the form in
which the entity was found. Numbers, addresses and secrets go through a keyed permutation (a Feistel network over the
entity's own character classes): script, length, punctuation, country code, trunk zero and check digits stay as they were.

Names. A title, or a frequent given name before a surname, begins a person. Given names get a made-up name of the
person's gender and script, surnames a made-up surname of the script; each is keyed by its own normal form, so
`Mrs Anna Keller`, `Dr. Anna KELLER` and a later `Keller` stay one person. A person's gender is that of a title with this
full name anywhere in the text, else anywhere in the corpus, else that of the given name (GIVEN, or by its last letter).
Once found, a name's parts are replaced without a title too, as they were written or with a capital, surnames also in
capitals; a given name alone in capitals is left.

Collision checks. All distinct entities of the corpus are gathered (distinct in each block, then by a partial
aggregation). Entities of one format (names of any kind; digits of phones and cards; secrets and keys; else the kind) are
checked together: a surrogate that another entity also got, or that is itself an entity somewhere in the corpus, is drawn
again with the next attempt until there is none. This is rare, so the documents need only the list of redrawn ones and of
genders that only the corpus tells: it is broadcast up to MOST_BROADCAST rows and joined by a digest of the text beyond.

The key is the caller's; without one nothing runs. Null text stays null. A text without entities stays as it is, byte by
byte. Repeated rows get equal results. Columns other than the text are kept, whatever their names; the spans' column has a
name that the caller gives. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, free_names, lean, materialize, texts

MOST_BROADCAST = 200_000
ROUNDS = 8

# Alphabets by rule: a letter is replaced by one of its own range.
_RANGES = [("0", "9"), ("a", "z"), ("A", "Z"), ("ß", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"), ("α", "ρ"), ("Α", "Ρ"), ("а", "я"), ("А", "Я"), ("א", "ת"), ("ع", "ي"), ("अ", "ह"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "鿿"), ("가", "힣")]
_HEX = "0123456789abcdef"

TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Sra", "Srta", "Señora", "Г-жа", "Κυρία"], "m": ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Г-н", "Κύριος"], "": ["Dr", "Prof"]}
_GENDER = {x: g for g, ts in TITLES.items() for t in ts for x in (t, t.upper())}
#: fixed values: frequent given names, which begin a person without a title if a surname follows
GIVEN = {
    "f": "Anna Maria Julia Laura Sarah Emma Olivia Sophia Isabella Charlotte Elizabeth Jennifer Jessica Linda Susan Karen Lisa Nancy Helen Sandra Katharina Johanna Claudia Monika Petra Sabine Ursula Ingrid Camille Chloé Léa Manon Carmen Lucía Elena Isabel Pilar Giulia Chiara Francesca".split(),
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Joshua Kevin Brian George Edward Ronald Hans Peter Klaus Jürgen Wolfgang Stefan Andreas Matthias Pierre Jean Jacques Louis Antoine Carlos José Antonio Francisco Javier Giovanni Giuseppe".split(),
}
_KNOWN = {x: g for g, names in GIVEN.items() for x in names}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω](?:[^\W\d_]+|['’][^\W\d_]+)(?:[-'’][^\W\d_]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: in order: where two overlap, the first holds
PATTERNS = {
    "secret": re.compile(r"(?i)(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-/+=.]{8,})"),
    "email": re.compile(r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})"),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ip": re.compile(rf"(?<![\d.])({_OCTET}(?:\.{_OCTET}){{3}})(?!\d|\.\d)"),
    "ssn": re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"),
    "phone": re.compile(r"(?<![\d+])(\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}|\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"),
    "card": re.compile(r"(?<![\d.])(\d(?:[ -]?\d){12,18})(?!\d)"),
    "key": re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])([0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"),
    "person": re.compile(r"(?<!\w)(%s)\.?\s+(%s(?:[ ]%s){0,2})" % ("|".join(sorted(_GENDER, key=len, reverse=True)), _NAME, _NAME)),
    "untitled": re.compile(r"(?<!\w)(%s)[ ](%s)(?!\w)" % ("|".join(sorted(_KNOWN, key=len, reverse=True)), _NAME)),
}
_DIGITS = re.compile(r"\d")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]\w*")
_TITLE_WORDS = {re.match(r"\w+", t)[0] for t in _GENDER}


def normal(name: str) -> str:
    return name.casefold().capitalize()


def gender_of(given: str) -> str:
    """The gender of a given name in normal form, if nothing else tells one."""
    return _KNOWN.get(given) or ("f" if given.endswith(("a", "e", "i", "y", "á", "é", "а", "я", "α", "η")) else "m")


def _parts(name: str, at: int) -> list[tuple[int, str]]:
    """(place, part) of the parts of a name that hyphens and apostrophes join; single letters stay as they are."""
    return [(at + m.start(), m[0]) for m in re.finditer(r"[^-'’ ]{2,}", name)]


def persons(text: str) -> list[tuple[str, str, list, list]]:
    """(gender or nothing, person, given name parts, surname parts) of every mention with a title or a known given name;
    person is the normal form of the full name, empty without a given name."""
    out, capitals = [], set(_CAPITAL.findall(text))
    # most texts have neither titles nor such names
    for m in () if _TITLE_WORDS.isdisjoint(capitals) else PATTERNS["person"].finditer(text):
        *given, (at, surname) = [(m.start(2) + p.start(), p[0]) for p in re.finditer(r"[^ ]+", m[2])]
        own = [x for p, name in given for x in _parts(name, p)]
        out.append((_GENDER[m[1]], " ".join(normal(n) for _, n in [*given, (at, surname)]) if given else "", own, _parts(surname, at)))
    for m in () if capitals.isdisjoint(_KNOWN) else PATTERNS["untitled"].finditer(text):
        out.append(("", f"{normal(m[1])} {normal(m[2])}", _parts(m[1], m.start(1)), _parts(m[2], m.start(2))))
    return out


def _resolve(mentions: list, genders: dict[str, str]) -> dict[str, str]:
    """The gender of each person of a text: by a title in the text, by genders, by the given name."""
    told: dict[str, str] = {}
    for gender, person, _, _ in mentions:
        if gender:
            told.setdefault(person, gender)
    return {person: told.get(person) or genders.get(person) or gender_of(person.split(" ")[0]) for _, person, _, _ in mentions}


def _names(text: str, mentions: list, genders: dict[str, str]) -> list[tuple[int, int, str, str]]:
    resolved, out, names = _resolve(mentions, genders), [], {}
    for gender, person, given, surname in mentions:
        kinds = [(x, f"given_{gender or resolved[person]}") for x in given] + [(x, "surname") for x in surname]
        for (at, part), kind in kinds:
            out.append((at, at + len(part), kind, normal(part)))
            for form in {part, normal(part), *([part.upper()] if kind == "surname" and len(part) > 2 else [])}:
                names.setdefault(form, (kind, normal(part)))
    if names:  # the same names without a title
        for m in re.finditer("|".join(rf"(?<!\w){re.escape(n)}(?!\w)" for n in sorted(names, key=len, reverse=True)), text):
            out.append((*m.span(), *names[m[0]]))
    return out


def find(text: str, genders: dict[str, str] = {}, mentions: list | None = None) -> list[tuple[int, int, str, str]]:  # noqa: B006
    """(start, stop, kind, value) of every entity, in order, none overlapping; value is its normal form. mentions: what
    persons() gives, if it is known."""
    out: list[tuple[int, int, str, str]] = []
    has_digit = _DIGITS.search(text) is not None
    run = {k: has_digit for k in ("iban", "ip", "ssn", "phone", "card", "key")}
    run |= {"secret": "=" in text or ":" in text, "email": "@" in text}
    for kind, pattern in PATTERNS.items():
        if run.get(kind):
            out += [(*m.span(1), kind, _value(kind, m[1])) for m in pattern.finditer(text)]
    out += _names(text, persons(text) if mentions is None else mentions, genders)
    held: list[tuple[int, int, str, str]] = []
    # in order of kind where two overlap; a sweep by place, as texts may be long
    rank = {k: i for i, k in enumerate(PATTERNS)}
    taken = bytearray(len(text) + 1) if len(out) > 1 else None
    for e in sorted(out, key=lambda e: rank.get(e[2], len(rank))):
        if taken is None or not any(taken[e[0] : e[1]]):
            held.append(e)
            if taken is not None:
                taken[e[0] : e[1]] = b"\1" * (e[1] - e[0])
    return sorted(held)


def _value(kind: str, found: str) -> str:
    if kind == "email":
        return found.lower()
    if kind == "phone":
        return re.sub(r"\D", "", _country(found)[1])
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", found)
    return found


#: fixed values: country codes of two digits; 1 and 7 are alone, all others have three
_TWO = {"20", "27", "36", "39", "98", *(str(n) for a, b in ((30, 34), (40, 41), (43, 49), (51, 58), (60, 66), (81, 82), (84, 84), (86, 86), (90, 95)) for n in range(a, b + 1))}


def _country(phone: str) -> tuple[str, str]:
    """(country code or trunk zeros, the rest) of a phone number as it was found."""
    if not phone.startswith("+"):
        m = re.match(r"\D*0*", phone)
        return phone[: m.end()], phone[m.end() :]
    size = 2 if phone[1] in "17" else 3 if phone[1:3] in _TWO else 4
    return phone[:size], phone[size:]


def permute(key: bytes, tweak: str, value: int, domain: int) -> int:
    """A keyed permutation of range(domain)."""
    if domain < 2:
        return value
    side = int(domain**0.5) if domain < 1 << 52 else 1 << (domain.bit_length() // 2)
    while side * side < domain:
        side += 1 + side // 1000
    while True:
        a, b = divmod(value, side)
        for r in range(ROUNDS):
            mac = hashlib.blake2b(f"{r}|{tweak}|{domain}|{b}".encode(), key=key, digest_size=64).digest()
            a, b = b, (a + int.from_bytes(mac, "big")) % side
        value = a * side + b
        if value < domain:  # else walk on, within the permutation of side * side
            return value


@lru_cache(maxsize=4096)
def _range_of(c: str) -> tuple[int, int] | None:
    return next(((ord(a), ord(b) - ord(a) + 1) for a, b in _RANGES if a <= c <= b), None)


def reshape(key: bytes, tweak: str, value: str, alphabet: str = "") -> str:
    """value with every letter and digit permuted within its class, and all else in its place."""
    classes = [(alphabet, len(alphabet)) if alphabet else _range_of(c) for c in value]
    number, domain = 0, 1
    for c, k in zip(value, classes, strict=True):
        if k:
            number = number * k[1] + (alphabet.index(c) if alphabet else ord(c) - k[0])
            domain *= k[1]
    pattern = "".join("." if k is None else f"<{k[0] if not alphabet else 'x'}>" for k in classes)
    number = permute(key, f"{tweak}|{pattern}|{''.join(c for c, k in zip(value, classes, strict=True) if not k)}", number, domain)
    out = []
    for c, k in zip(reversed(value), reversed(classes), strict=True):
        if k:
            number, digit = divmod(number, k[1])
            c = alphabet[digit] if alphabet else chr(k[0] + digit)
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> str:
    """The check digit that makes digits + it pass."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


# Parts of made-up names by script: consonants, vowels, endings of given names by gender and of surnames.
_SYLLABLES = {
    "Latin": ("bdfglmnprstv", "aeio", {"f": ["a", "ia", "ina", "elle"], "m": ["o", "us", "er", "an"], "": ["mann", "berg", "sen", "ton", "well", "ley"]}),
    "Cyrillic": ("бвгдлмнпрст", "аеио", {"f": ["а", "ия", "ина"], "m": ["ор", "ий", "ан"], "": ["енко", "ович", "ских"]}),
    "Greek": ("βγδλμνπρστ", "αειο", {"f": ["α", "η"], "m": ["ος", "ης"], "": ["ίδης", "άκης", "πουλος"]}),
}


def script(value: str) -> str:
    c = ord(next((x for x in value if x.isalpha()), "a"))
    return "Greek" if 0x370 <= c < 0x400 else "Cyrillic" if 0x400 <= c < 0x530 else "Latin" if c < 0x250 else "other"


def made_up(key: bytes, gender: str, value: str, attempt: int) -> str:
    """A given name of the gender, or a surname without one, in the script of the value and from its keyed digest; it
    grows with the attempts, so there is always another one."""
    consonants, vowels, endings = _SYLLABLES[script(value)]
    out = ""
    for i in range(3 + attempt // 3):
        n = int.from_bytes(hashlib.blake2b(f"{gender or 'surname'}|{value}|{attempt}|{i}".encode(), key=key, digest_size=16).digest(), "big")
        n, c = divmod(n, len(consonants))
        out += consonants[c] + vowels[n % len(vowels)]
    return (out[:-1] + endings[gender][n // 7 % len(endings[gender])]).capitalize()


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a value; another for each attempt."""
    tweak = f"{kind}|{attempt}"
    if kind == "ip":
        n = 0
        for octet in value.split("."):
            n = n * 256 + int(octet)
        n = permute(key, tweak, n, 1 << 32)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card" and luhn(value[:-1]) == value[-1]:
        body = reshape(key, tweak, value[:-1])
        return body + luhn(body)
    if kind == "iban":
        body = reshape(key, tweak, value[4:])
        number = int("".join(str(int(c, 36)) for c in f"{body}{value[:2]}00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "email":
        name, _, host = value.rpartition("@")
        site, _, top = host.rpartition(".")
        return f"{reshape(key, tweak, name)}@{reshape(key, tweak + '@', site)}.{top}"
    if kind in ("secret", "key") and set(value) <= set(_HEX):
        return reshape(key, tweak, value, _HEX)
    if kind in ("secret", "key") and set(value) <= set(_HEX.upper()):
        return reshape(key, tweak, value, _HEX.upper())
    if kind.startswith(("given_", "surname")) and script(value) != "other":
        return made_up(key, kind[6:] if kind.startswith("given_") else "", value, attempt)
    return reshape(key, "name" + tweak if kind.startswith(("given", "surname")) else tweak, value)


def rendered(kind: str, found: str, new: str) -> str:
    """The surrogate in the form in which the entity was found."""
    if kind == "email":
        return new.upper() if found.isupper() else new
    if kind == "phone":
        country, rest = _country(found)
        digits = iter(new)
        return country + "".join(next(digits) if c.isdigit() else c for c in rest)
    if kind.startswith(("given_", "surname")):
        return new.upper() if found.isupper() and len(found) > 1 else new
    if kind in ("card", "iban"):
        kept = iter(new)
        return "".join(c if c in " -" else next(kept) for c in found)
    return new


def replace(text: str, key: bytes, redrawn: dict[tuple[str, str], int], genders: dict[str, str] = {}) -> tuple[str, list[tuple[str, int, int]]]:  # noqa: B006
    """The text with surrogates, and (kind, start, stop) of each in the new text."""
    out, at, spans, size = [], 0, [], 0
    for start, stop, kind, value in find(text, genders):
        new = rendered(kind, text[start:stop], surrogate(key, kind, value, redrawn.get((kind, value), 0)))
        out += [text[at:start], new]
        size += start - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = stop
    return ("".join([*out, text[at:]]), spans) if out else (text, [])


def _extract(text_col: str, with_text: bool):
    def run(batches):
        for batch in batches:
            seen: dict = {}
            for t in texts(batch, text_col):
                digest = hashlib.sha256(t.encode()).digest() if with_text else b""
                mentions = persons(t)
                resolved = _resolve(mentions, {})
                told = {person for gender, person, _, _ in mentions if gender}
                for gender, person, _, _ in mentions:
                    if person and gender:
                        seen[digest, f"person_{gender}", person] = None
                    elif person and person not in told:  # the corpus may tell the gender; the letter is what holds else
                        seen[digest, f"open_{resolved[person]}", person] = None
                for _, _, kind, value in find(t, mentions=mentions):
                    seen[digest, kind, value] = None
            if seen:
                digest, kind, value = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(kind), pa.array(value)], names=["digest", "kind", "value"])

    return run


def _draw(key: bytes):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            new = [surrogate(key, r["kind"], r["value"], r["attempt"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(new, pa.string())], names=["kind", "value", "attempt", "new"])

    return run


def _format(kind) -> Column:
    """What surrogates of one format have to differ in."""
    return F.when(kind.startswith("given_") | (kind == "surname"), "name").when(kind.isin("phone", "card"), "digits").when(kind.isin("secret", "key"), "token").otherwise(kind)


def mapping(docs: DataFrame, key: bytes, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((kind, value, attempt, new) of every distinct entity, (kind, value, gender) of the persons whose gender the corpus
    tells otherwise than the texts that have no title for them): new values are distinct within a format and are no
    entity of it. kind of a person is as _extract gives it."""
    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(_extract("text", False)), "digest binary, kind string, value string")
    found = materialize(found.select("kind", "value").distinct())
    is_person = F.col("kind").startswith("person_") | F.col("kind").startswith("open_")
    has = lambda kind: F.bool_or(F.col("kind") == kind).alias(kind)
    people = found.where(is_person).groupBy("value").agg(*(has(k) for k in ("person_f", "person_m", "open_f", "open_m"))).where("person_f != person_m")
    told = F.when(F.col("person_f"), "f").otherwise("m")
    genders = materialize(people.where((told == "f") & F.col("open_m") | (told == "m") & F.col("open_f")).select(F.when(F.col("open_f"), "open_f").otherwise("open_m").alias("kind"), "value", told.alias("gender")))
    # a given name of the other gender, too
    others = genders.select(F.concat(F.lit("given_"), "gender").alias("kind"), F.explode(F.regexp_extract_all(F.regexp_replace("value", " [^ ]+$", ""), F.lit("([^-'’ ]{2,})"))).alias("value"))
    entities = materialize(found.where(~is_person).unionByName(others.select("kind", F.initcap("value").alias("value"))).distinct())
    schema = "kind string, value string, attempt int, new string"
    done = materialize(entities.withColumn("attempt", F.lit(0)).mapInArrow(lean(_draw(key)), schema))
    real = entities.select(_format(F.col("kind")).alias("_format"), F.col("value").alias("new"), F.lit(True).alias("_real")).distinct()
    while True:
        first = F.row_number().over(Window.partitionBy("_format", "new").orderBy("attempt", "kind", "value"))
        # a group of equal surrogates is as small as the permutation makes it
        clash = done.withColumn("_format", _format(F.col("kind"))).withColumn("_n", first).join(real, ["_format", "new"], "left")
        again = clash.withColumn("_again", (F.col("_n") > 1) | F.col("_real").isNotNull()).select("kind", "value", "attempt", "new", "_again")
        if again.where("_again").limit(1).count() == 0:
            return done, genders
        redrawn = again.where("_again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(lean(_draw(key)), schema)
        done = materialize(again.where("NOT _again").drop("_again").unionByName(redrawn))


def _known(rows) -> tuple[dict, dict]:
    """(attempts by kind and value, genders by person) of rows (kind, value, attempt, gender)."""
    return {(r["kind"], r["value"]): r["attempt"] for r in rows if r["gender"] is None}, {r["value"]: r["gender"] for r in rows if r["gender"]}


def _apply(key: bytes, held, text_at: int, names: list[str]):
    """names: of the columns that come out, the spans last."""

    def run(batches):
        for batch in batches:
            column = batch.column(text_at).to_pylist()
            own = batch.column(batch.num_columns - 1).to_pylist() if held is None else None
            new, spans = [], []
            for i, t in enumerate(column):
                attempts, genders = held.value if held else _known(own[i] or [])
                text, s = (None, []) if t is None else replace(t, key, attempts, genders)
                new.append(text)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in s])
            columns = [pa.array(new, pa.string()) if i == text_at else batch.column(i) for i in range(len(names) - 1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=names)

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def session_key(spark) -> bytes:
    """The key in spark.tallyspark.surrogates.secret, for callers that have none to give; where it is unset, one drawn
    for this driver process and kept nowhere, so nobody can undo the surrogates, nor match those of another run."""
    own = spark.conf.get("spark.tallyspark.surrogates.secret", None)
    return own.encode() if own else _PROCESS_KEY


_PROCESS_KEY = secrets.token_bytes(32)


def anonymize(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "_spans") -> DataFrame:
    """docs with surrogates in text_col, and spans_col: array of (kind, start, stop) of each surrogate in the new text. A
    column that has this name already stays, and the new one, still the last, gets underscores until its name is free."""
    if not key:
        raise ValueError("surrogates need a key")
    spark, names = docs.sparkSession, docs.columns
    (spans_col,) = free_names(docs, [spans_col])
    done, genders = mapping(docs, key, text_col)
    redrawn = done.where("attempt > 0").select("kind", "value", "attempt", F.lit(None).cast("string").alias("gender"))
    redrawn = redrawn.unionByName(genders.select("kind", "value", F.lit(0).alias("attempt"), "gender"))
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, _SPANS)])
    at = names.index(text_col)
    rows = redrawn.limit(MOST_BROADCAST + 1).collect()
    if len(rows) <= MOST_BROADCAST:
        # by place, as names may hold anything
        return docs.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(lean(_apply(key, spark.sparkContext.broadcast(_known(rows)), at, [*names, spans_col])), schema)
    # too many to send to every task: each text gets those of its own
    text = F.col(f"`{text_col}`")
    own = docs.select(text.alias("text")).mapInArrow(lean(_extract("text", True)), "digest binary, kind string, value string").distinct()
    own = own.join(redrawn, ["kind", "value"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "value", "attempt", "gender")).alias("_own"))
    packed = docs.select(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(columns_of(docs)))).alias("_row"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return packed.join(own, "digest", "left").select("_row.*", "_own").mapInArrow(lean(_apply(key, None, at, [*names, spans_col])), schema)


def op2_surrogates(spark, sf_dir: str, key: bytes = b"") -> DataFrame:
    """Every document with surrogates for its personal data, their number, and where they are. The key is that of the
    session if none is given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = anonymize(docs, key or session_key(spark))
    return out.select("doc_id", "text", F.size("_spans").cast("long").alias("n_entities"), F.col("_spans").alias("spans"))
