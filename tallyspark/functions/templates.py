"""Prompt templates as Columns: `{{ a.b | filter }}`, `{% for x in list %}`, `{% if a %}` with `{% else %}`.

A template is parsed once on the driver and becomes one expression, so rendering is a projection. Names are looked up in
the columns that the caller gives: a struct's fields by dots, a map's values by their key. A name that isn't there is an
error, as is a filter that isn't known."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_FOR = re.compile(r"for\s+(\w+)\s+in\s+(.+)$", re.DOTALL)


class TemplateError(ValueError):
    pass


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


FILTERS: dict[str, Callable[..., Column]] = {
    "upper": F.upper,
    "lower": F.lower,
    "trim": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""),
    "length": F.length,
    "join": lambda c, sep="": F.array_join(c, sep),
    "first": lambda c: F.get(c, F.lit(0)),
    "default": lambda c, value="": F.coalesce(c.cast("string"), F.lit(value)),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)),
}


def _value(source: str, names: dict[str, Column]) -> Column:
    head, *filters = re.split(r"\|(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", source)
    head = head.strip()
    if m := re.fullmatch(r"'([^']*)'|\"([^\"]*)\"", head):
        out = F.lit(m[1] if m[1] is not None else m[2])
    else:
        root, *path = head.split(".")
        if root not in names:
            raise TemplateError(f"{root!r} is not defined; there are {sorted(names)}")
        out = names[root]
        for key in path:
            out = out.getItem(key)
    for f in filters:
        m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", f, re.DOTALL)
        if not m or m[1] not in FILTERS:
            raise TemplateError(f"no filter {f.strip()!r}; there are {sorted(FILTERS)}")
        out = FILTERS[m[1]](out, *(a[1:-1] for a in re.findall(r"'[^']*'|\"[^\"]*\"", m[2] or "")))
    return out


def _truth(source: str, names: dict[str, Column], arrays: set[str]) -> Column:
    source = source.strip()
    if source.startswith("not "):
        return ~_truth(source[4:], names, arrays)
    if m := re.fullmatch(r"(.+?)\s*(==|!=)\s*(.+)", source):
        same = _text(_value(m[1], names)) == _text(_value(m[3], names))
        return same if m[2] == "==" else ~same
    value = _value(source, names)
    return F.coalesce(F.size(value) > 0, F.lit(False)) if source in arrays else _text(value) != ""


def _blocks(tokens: list[str], at: int, ends: tuple[str, ...]) -> tuple[list, int, str]:
    """(parts, place after the closing tag, closing tag) of the tokens from at on."""
    out = []
    while at < len(tokens):
        token = tokens[at]
        at += 1
        if token.startswith("{%"):
            tag = token[2:-2].strip(" -\n\t")
            if tag in ends:
                return out, at, tag
            if tag.startswith("for "):
                body, at, _ = _blocks(tokens, at, ("endfor",))
                out.append(("for", tag, body))
            elif tag.startswith("if "):
                body, at, end = _blocks(tokens, at, ("else", "endif"))
                other: list = []
                if end == "else":
                    other, at, _ = _blocks(tokens, at, ("endif",))
                out.append(("if", tag[3:], body, other))
            else:
                raise TemplateError(f"no tag {tag!r} here")
        elif token.startswith("{{"):
            out.append(("value", token[2:-2].strip()))
        elif token:
            out.append(("text", token))
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return out, at, ""


def _render(parts: list, names: dict[str, Column], arrays: set[str]) -> Column:
    out = []
    for kind, *rest in parts:
        if kind == "text":
            out.append(F.lit(rest[0]))
        elif kind == "value":
            out.append(_text(_value(rest[0], names)))
        elif kind == "if":
            out.append(F.when(_truth(rest[0], names, arrays), _render(rest[1], names, arrays)).otherwise(_render(rest[2], names, arrays)))
        else:
            m = _FOR.fullmatch(rest[0])
            if not m:
                raise TemplateError(f"no loop: {rest[0]!r}")
            each = F.transform(_value(m[2], names), _each(m[1], rest[1], names, arrays))
            out.append(F.coalesce(F.array_join(each, ""), F.lit("")))
    return F.concat(*out) if out else F.lit("")


def _each(name: str, body: list, names: dict[str, Column], arrays: set[str]) -> Callable[[Column], Column]:
    return lambda x: _render(body, {**names, name: x}, arrays)


def render(template: str, names: dict[str, Column], arrays: set[str] = frozenset()) -> Column:
    """The template filled in; arrays are the names that hold arrays, which are true if they have elements."""
    parts, _, _ = _blocks(_TAG.split(template), 0, ())
    return _render(parts, names, set(arrays))


def candidate_labels(labels: Column) -> Column:
    """The labels of an example, given as JSON, for a template's loops: a text's parts between commas, or a list's strings."""
    from ..schemas import normalize_labels, strip

    x = normalize_labels(labels)
    items = F.when(x["kind"] == "text", F.split(x["text"], ",")).when(x["kind"] == "list", x["list"]).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(items, strip), lambda s: s.isNotNull() & (s != ""))
