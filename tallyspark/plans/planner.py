"""Which cleaning steps a task gets, from its type and its vocabulary; decided on the driver, run as Columns.

Both planners read one table: the first row that names the planner, the kind of vocabulary and the kind of task gives the
parser and the steps. Every plan begins with START."""

from __future__ import annotations

import json
from collections.abc import Callable

Step = tuple[str, dict]
START: list[Step] = [("normalize_whitespace", {}), ("strip_eos", {})]
FREE_TEXT = {"captioning", "qa", "open_ended", "counting"}
INLINE, OFFLINE = "inline", "offline"


def _all(vocab: list[str], test: Callable[[str], bool]) -> bool:
    return all(test(v.strip().lower()) for v in vocab)


#: kinds of vocabulary, the first that holds; names are labels of several words
KINDS: list[tuple[str, Callable[[list[str]], bool]]] = [
    ("none", lambda v: not v),
    ("yes_no", lambda v: {x.lower() for x in v} == {"yes", "no"}),
    ("letters", lambda v: _all(v, lambda x: len(x) == 1 and x.isalpha()) and 2 <= len({x.strip().lower() for x in v}) <= 10),
    ("hz", lambda v: _all(v, lambda x: x.endswith("hz") and x.split()[0].isdigit())),
    ("names", lambda v: _all(v, lambda x: " " in x)),
    ("plain", lambda v: True),
]

#: steps by name, given the vocabulary
STEPS: dict[str, Callable[[list[str]], list[Step]]] = {
    "nothing": lambda v: [],
    "label": lambda v: [("extract_label_from_text", {"labels": v})],
    "letter": lambda v: [("extract_mcq_choice_from_text", {"labels": v})],
    "bucket": lambda v: [("extract_hz_bucket_from_text", {"labels": v})],
    "species": lambda v: [("extract_scientific_name_from_text", {"labels": v, "min_score": 1.0}), ("extract_label_from_text", {"labels": v})],
    "cautious": lambda v: [("conservative_match_to_labels", {"labels": v, "max_distance": 2, "allow_fuzzy": True, "drop_unmatched": True})],
    "nearest": lambda v: [("fuzzy_match_to_labels", {"labels": v})],
}

_OPEN = ("names", "plain")
#: planners, kinds of vocabulary, kind of task (any: None), whether answers are lists parted by commas, steps
TABLE: list[tuple[tuple, tuple, str | None, bool, str]] = [
    ((INLINE,), ("names",), "free", False, "species"),
    ((INLINE,), tuple(k for k, _ in KINDS), "free", False, "nothing"),
    ((INLINE, OFFLINE), ("yes_no",), None, False, "label"),
    ((INLINE, OFFLINE), ("letters",), None, False, "letter"),
    ((INLINE, OFFLINE), ("hz",), None, False, "bucket"),
    ((INLINE,), ("names",), "single", False, "species"),
    ((INLINE, OFFLINE), _OPEN, "single", False, "label"),
    ((INLINE, OFFLINE), ("none",), "single", False, "nothing"),
    ((INLINE,), _OPEN, None, True, "cautious"),
    ((OFFLINE,), _OPEN, None, True, "nearest"),
    ((INLINE, OFFLINE), ("none",), None, True, "nothing"),
]


def kind_of(vocab: list[str]) -> str:
    return next(name for name, holds in KINDS if holds(vocab))


def spaced(labels: list[str]) -> bool:
    return bool(labels) and _all(labels, lambda x: " " in x)


def _plan(planner: str, vocab: list[str], task: str, kind: str | None = None) -> tuple[list[Step], list[Step]]:
    kind = kind or kind_of(vocab)
    listed, steps = next((listed, steps) for who, kinds, of, listed, steps in TABLE if planner in who and kind in kinds and of in (None, task))
    return [("parse_labels_comma", {})] if listed else [], [*START, *STEPS[steps](vocab)]


def plan_inline(vocab: list[str], task_type: str | None, override: list[str] | None = None) -> tuple[list[Step], list[Step]]:
    """(parsers, cleaners) of a run; override is the task's own vocabulary, which goes before the one collected from
    examples. Free text knows the task's own one only, and of that only whether its labels are of several words."""
    if task_type in FREE_TEXT:
        return _plan(INLINE, override or [], "free", "names" if override and spaced(override) else "none")
    return _plan(INLINE, override or vocab, "single" if task_type == "classification" else "other")


def plan_offline(vocab: list[str], task_type: str | None = None) -> tuple[list[Step], list[Step]]:
    """(parsers, cleaners) of a later rescoring, which has no case for free text and snaps detections to the nearest label."""
    task = (task_type or "").lower()
    return _plan(OFFLINE, vocab, "single" if "classification" in task and "detection" not in task else "other")


def fingerprint(parsers: list[Step], cleaners: list[Step]) -> str:
    """The steps as canonical JSON: sorted keys, no blanks, characters beyond ASCII kept."""
    return json.dumps({"cleaners": cleaners, "parsers": parsers}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
