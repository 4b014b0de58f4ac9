"""CSS selectors over the elements of one page.

A selector becomes steps of simple tests; each step is one sweep over the elements in document order
with the answers of the step before, looked up by parent or by previous sibling.  So the time is
linear in elements and steps, whatever the nesting.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import cloudpickle

# Executors need not have this package: the helper travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NAME = r"-?(?:[^\W\d]|[^\x00-\x7f])(?:[\w-]|[^\x00-\x7f])*|--(?:[\w-]|[^\x00-\x7f])*"
_PART = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\#(?P<id>(?:[\w-]|[^\x00-\x7f])+)|\.(?P<cls>{_NAME})"""
    rf"""|\[\s*(?P<attr>{_NAME}(?::{_NAME})?)\s*(?:(?P<test>[~|^$*!]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^"'\]\s]*))\s*(?P<flag>[iIsS])?\s*)?\]"""
    rf"""|:(?P<pseudo>{_NAME})(?P<open>\()?"""
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+(?![,)]|$)")
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*\)", re.IGNORECASE)
_WORD = re.compile(r"[^ \t\n\x0c\r]+")

# Places among siblings, as (step, offset, from the end, of the same name).
_PLACES = {
    "first-child": (0, 1, False, False), "last-child": (0, 1, True, False),
    "first-of-type": (0, 1, False, True), "last-of-type": (0, 1, True, True),
}
_NTH_PLACES = {"nth-child": (False, False), "nth-last-child": (True, False), "nth-of-type": (False, True), "nth-last-of-type": (True, True)}
_ONLY = {"only-child": ("first-child", "last-child"), "only-of-type": ("first-of-type", "last-of-type")}


class Unsupported(ValueError):
    """A selector with a part that is not built."""


@dataclass
class Elements:
    """The elements of a page in document order; parents come before their children."""

    tags: list[str]
    parents: list[int]  # index of the parent, -1 at the top
    attributes: Callable[[int], dict[str, str]]

    def __post_init__(self) -> None:
        self._places: dict[tuple[bool, bool], list[int]] = {}
        self.previous = [-1] * len(self.tags)
        last: dict[int, int] = {}
        for i, parent in enumerate(self.parents):
            self.previous[i] = last.get(parent, -1)
            last[parent] = i

    def places(self, from_end: bool, of_type: bool) -> list[int]:
        """The number of each element among its siblings, from 1."""
        if (from_end, of_type) not in self._places:
            counts: dict[tuple, int] = {}
            out = [0] * len(self.tags)
            order = range(len(self.tags) - 1, -1, -1) if from_end else range(len(self.tags))
            for i in order:
                key = (self.parents[i], self.tags[i] if of_type else "")
                counts[key] = out[i] = counts.get(key, 0) + 1
            self._places[from_end, of_type] = out
        return self._places[from_end, of_type]


def _nth(a: int, b: int, place: int) -> bool:
    """Is ``place`` a n + b for some n from 0?"""
    return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


def _attribute_test(name: str, test: str | None, want: str, flag: str | None) -> Callable[[dict[str, str]], bool]:
    if test is None:
        return lambda have: name in have
    # in HTML the value of ``type`` is compared without case unless the selector says otherwise
    fold = (flag or ("i" if name == "type" else "s")).lower() == "i"
    want = want.lower() if fold else want
    passes = {
        "=": lambda v: v == want,
        "!=": lambda v: v != want,
        "~=": lambda v: want in _WORD.findall(v) if want else False,
        "|=": lambda v: v == want or v.startswith(want + "-"),
        "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want),
        "*=": lambda v: bool(want) and want in v,
    }[test]
    if test == "!=":
        return lambda have: name not in have or passes(have[name].lower() if fold else have[name])
    return lambda have: name in have and passes(have[name].lower() if fold else have[name])


class Compound:
    """Tests on one element: name, attributes, place, and selectors that it must or must not match."""

    def __init__(self) -> None:
        self.tag: str | None = None
        self.tests: list[Callable[[dict[str, str]], bool]] = []
        self.places: list[tuple[int, int, bool, bool]] = []
        self.nested: list[tuple[bool, Selector]] = []

    def matches(self, page: Elements) -> list[bool]:
        out = [True] * len(page.tags) if self.tag is None else [t == self.tag for t in page.tags]
        for a, b, from_end, of_type in self.places:
            out = [m and _nth(a, b, p) for m, p in zip(out, page.places(from_end, of_type), strict=True)]
        for wanted, selector in self.nested:
            out = [m and n == wanted for m, n in zip(out, selector.matches(page), strict=True)]
        if self.tests:
            out = [m and all(test(have) for have in [page.attributes(i)] for test in self.tests) for i, m in enumerate(out)]
        return out


class Selector:
    """Alternatives, each a list of (combinator, compound)."""

    def __init__(self, alternatives: list[list[tuple[str, Compound]]]):
        self.alternatives = alternatives

    def matches(self, page: Elements) -> list[bool]:
        found = [False] * len(page.tags)
        for steps in self.alternatives:
            found = [a or b for a, b in zip(found, _chain(steps, page), strict=True)]
        return found


def _chain(steps: list[tuple[str, Compound]], page: Elements) -> list[bool]:
    before: list[bool] = []
    for combinator, compound in steps:
        here = compound.matches(page)
        if combinator:
            link = page.parents if combinator in (" ", ">") else page.previous
            if combinator in ">+":
                here = [m and j >= 0 and before[j] for m, j in zip(here, link, strict=True)]
            else:  # above or before at any distance: what the neighbour is, or has itself
                reach = [False] * len(here)
                for i, j in enumerate(link):
                    reach[i] = j >= 0 and (before[j] or reach[j])
                here = [m and r for m, r in zip(here, reach, strict=True)]
        before = here
    return before


def _read_list(text: str, at: int, closing: bool) -> tuple[Selector, int]:
    """A comma list from ``at`` on, up to the end of the text or to a closing parenthesis."""
    alternatives = []
    while True:
        steps, combinator = [], ""
        at = _blanks(text, at)
        while True:
            compound, at = _read_compound(text, at)
            steps.append((combinator, compound))
            m = _COMBINATOR.match(text, at)
            if not m:
                break
            combinator, at = m[1] or " ", m.end()
        alternatives.append(steps)
        at = _blanks(text, at)
        if at < len(text) and text[at] == ",":
            at += 1
        elif closing and at < len(text) and text[at] == ")":
            return Selector(alternatives), at + 1
        elif not closing and at == len(text):
            return Selector(alternatives), at
        else:
            raise Unsupported(text)


def _blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _read_compound(text: str, at: int) -> tuple[Compound, int]:
    compound, begin = Compound(), at
    while m := _PART.match(text, at):
        if m["tag"]:
            if at != begin:
                raise Unsupported(text)
            compound.tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            compound.tests.append(_attribute_test("id", "=", m["id"], "s"))
        elif m["cls"]:
            compound.tests.append(_attribute_test("class", "~=", m["cls"], "s"))
        elif m["attr"]:
            want = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
            compound.tests.append(_attribute_test(m["attr"].lower(), m["test"], want, m["flag"]))
        else:
            at = _read_pseudo(text, m, compound)
            continue
        at = m.end()
    if at == begin:
        raise Unsupported(text)
    return compound, at


def _read_pseudo(text: str, m: re.Match, compound: Compound) -> int:
    name = m["pseudo"].lower()
    if m["open"] and name in _NTH_PLACES:
        n = _NTH.match(text, m.end())
        if not n:
            raise Unsupported(text)
        if n["word"]:
            a, b = 2, 1 if n["word"].lower() == "odd" else 0
        elif n["only"]:
            a, b = 0, int(n["only"])
        else:
            a = int(n["a"] + "1") if n["a"] in ("", "+", "-") else int(n["a"])
            b = int((n["sign"] or "+") + (n["b"] or "0"))
        compound.places.append((a, b, *_NTH_PLACES[name]))
        return n.end()
    if m["open"] and name in ("not", "is", "where", "matches"):
        selector, at = _read_list(text, m.end(), closing=True)
        compound.nested.append((name != "not", selector))
        return at
    if not m["open"] and name in _PLACES:
        compound.places.append(_PLACES[name])
        return m.end()
    if not m["open"] and name in _ONLY:
        compound.places += [_PLACES[p] for p in _ONLY[name]]
        return m.end()
    raise Unsupported(text)


@lru_cache(maxsize=4096)
def compiled(selector: str) -> Selector | None:
    """The selector ready for use; None if it has a part that is not built."""
    try:
        return _read_list(selector.strip(), 0, closing=False)[0]
    except Unsupported:
        return None


def first_match(selector: Selector, page: Elements) -> int | None:
    """Index of the first element in document order that matches."""
    return next((i for i, hit in enumerate(selector.matches(page)) if hit), None)
