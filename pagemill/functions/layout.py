"""The tree of a page, from the kinds and names of its tokens.

Matching end tags to start tags needs a stack that lives across the tokens of a page.  Column
expressions have no such thing: a fold over arrays copies its whole state at every step.  So this
one step runs as an Arrow UDF; it sees a few characters per token, and of the document only the start tags
of pages that come with selectors.  All that depends on nesting is decided here: extents, region depths, the
main element, what its extraction takes out of the page, and the elements that selectors find.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.references import COMMON_REFERENCES
from pagemill.functions.selectors import Elements, compiled, first_match

# Executors need not have this package: the helper travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Regions that density scoring leaves out, that a page sample leaves out,
# and elements whose strings are not part of the text around them.
AROUND_CONTENT_TAGS = ("header", "footer", "nav", "aside")
SAMPLE_SKIP_TAGS = ("noscript", "svg")
HIDDEN_TAGS = ("template", "rt", "rp")
# Elements scored by density, and the least text they must have.
BLOCK_TAGS = ("div", "section", "article")
LEAST_BLOCK_TEXT = 100

# Codes of tokens: a start tag is the character of its flags in CODES, an element without content the one
# after those; flags are TRACK (report it), CUT (goes when it lies inside the main element) and PRIO times its rank
# as a container of the main content.
TRACK, CUT, PRIO = 1, 2, 4
RANKS = 16
_START, _VOID = 0x4E00, 0x4E00 + PRIO * RANKS
CODES = "".join(chr(_START + i) for i in range(2 * PRIO * RANKS))
TEXT, END_TAG, RAW, OTHER = "t", "/", "r", "."

END_OF_PAGE = 2147483647
_ELEM = ("pos", "end", "gone", "around", "skipped", "t_from", "t_to", "text_len", "html_len")
_TEXT = ("pos", "gone", "skipped")
_MAIN = ("pos", "end", "t_from", "t_to")
_HIT = ("field", "pos", "t_from", "t_to")


def _struct(names: tuple[str, ...], first: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, first if first and i == 0 else T.IntegerType()) for i, n in enumerate(names)])


LAYOUT_TYPE = T.StructType(
    [
        T.StructField("elems", T.ArrayType(_struct(_ELEM))),
        T.StructField("texts", T.ArrayType(_struct(_TEXT))),
        T.StructField("main", _struct(_MAIN)),
        T.StructField("by_density", T.BooleanType()),
        T.StructField("hits", T.ArrayType(_struct(_HIT, T.StringType()))),
        T.StructField("unsupported", T.ArrayType(T.StringType())),
    ]
)


class Page:
    """Elements and visible texts of one page.

    An end tag closes the innermost open element of its name and all inside it; one that matches nothing
    is ignored.  Sizes are null for a page with a known container, as only density needs them.
    """

    def __init__(self, kinds: str, names: str, sizes: str | None, text_sizes: str | None):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.flags: list[int] = []
        self.starts: list[int] = []  # number of the start tag
        # pos, end, unwanted, around, skipped, t_from, t_to, text_len, html_len
        self.rows: list[list[int]] = []
        self.texts: list[tuple[int, int, int, int]] = []  # pos, unwanted, around, skipped
        stack: list[tuple] = []
        is_open: Counter[str] = Counter()
        tag_names = iter(names.split(" "))
        text_lengths = map(int, text_sizes.split()) if text_sizes else iter(int, 1)
        markup = map(int, sizes.split()) if sizes else iter(int, 1)
        unwanted = around = skipped = hidden = 0
        count = text_sum = html_sum = n_starts = 0

        def close_last(end: int) -> str:
            nonlocal unwanted, around, skipped, hidden, html_sum
            name, i, before, text_before, html_before = stack.pop()
            is_open[name] -= 1
            row = self.rows[i]
            if row[3] == 0:
                html_sum += len(name) + 3
            row[1], row[6], row[7], row[8] = end, count, text_sum - text_before, html_sum - html_before
            unwanted, around, skipped, hidden = before
            return name

        def add(name: str, flags: int, row: list[int]) -> None:
            self.tags.append(name)
            self.parents.append(stack[-1][1] if stack else -1)
            self.flags.append(flags)
            self.starts.append(n_starts)
            self.rows.append(row)

        for pos, kind in enumerate(kinds):
            size = next(markup)
            if kind == TEXT:
                length = next(text_lengths)
                if not hidden:
                    count += 1
                    self.texts.append((pos, unwanted, around, skipped))
                    text_sum += 0 if around else length
                html_sum += 0 if around else size
            elif kind == END_TAG:
                name = next(tag_names)
                while is_open[name]:
                    if close_last(pos) == name:
                        break
            elif kind == OTHER:
                html_sum += 0 if around else size
            elif kind == RAW or ord(kind) >= _VOID:
                html_sum += 0 if around else size
                flags = CUT if kind == RAW else ord(kind) - _VOID
                add(next(tag_names), flags, [pos, pos, unwanted + (flags & CUT != 0), around, skipped, count + 1, count, 0, size])
                n_starts += 1
            else:
                name, flags = next(tag_names), ord(kind) - _START
                before, text_before, html_before = (unwanted, around, skipped, hidden), text_sum, html_sum
                unwanted += flags & CUT != 0
                around += name in AROUND_CONTENT_TAGS
                skipped += name in SAMPLE_SKIP_TAGS
                hidden += name in HIDDEN_TAGS
                html_sum += 0 if around else size
                add(name, flags, [pos, END_OF_PAGE, unwanted, around, skipped, count + 1, count, 0, 0])
                n_starts += 1
                stack.append((name, len(self.rows) - 1, before, text_before, html_before))
                is_open[name] += 1
        while stack:
            close_last(END_OF_PAGE)
        self.main = self._main()

    def _main(self) -> list[int] | None:
        """The container of the best rank, the first one of that rank; without one the densest block."""
        ranked = [(f // PRIO, i) for i, f in enumerate(self.flags) if f >= PRIO]
        self.by_density = not ranked
        if ranked:
            return self.rows[min(ranked)[1]]
        best, main = 0.0, None
        for tag, row in zip(self.tags, self.rows, strict=True):
            if tag in BLOCK_TAGS and row[3] == 0 and row[7] >= LEAST_BLOCK_TEXT and row[8] > 0 and row[7] / row[8] > best:
                best, main = row[7] / row[8], row
        return main

    def is_gone(self, pos: int, unwanted: int, around: int) -> bool:
        """Was what stands at ``pos`` taken out of the page by main-content extraction?

        Inside the main element everything unwanted goes; when density decides, header, footer, nav
        and aside go from the whole page first.
        """
        if self.by_density and around:
            return True
        main = self.main
        return main is not None and main[0] < pos < main[1] and unwanted > main[2]

    def elem_rows(self) -> list[tuple[int, ...]]:
        return [
            (r[0], r[1], self.is_gone(r[0], r[2], r[3]), r[3], r[4], r[5], r[6], r[7], r[8])
            for r, flags in zip(self.rows, self.flags, strict=True)
            if flags & TRACK
        ]

    def text_rows(self) -> list[tuple[int, ...]]:
        return [(pos, self.is_gone(pos, unwanted, around), skipped) for pos, unwanted, around, skipped in self.texts]

    def live(self, tokens: list[str]) -> tuple[Elements, list[int]]:
        """The elements left after main-content extraction, and their rows; ``tokens`` are the start tags."""
        kept = [i for i, r in enumerate(self.rows) if not self.is_gone(r[0], r[2], r[3])]
        place = {i: k for k, i in enumerate(kept)}
        place[-1] = -1
        read: dict[int, dict[str, str]] = {}

        def attributes(k: int) -> dict[str, str]:
            if k not in read:
                read[k] = attributes_of(tokens[self.starts[kept[k]]])
            return read[k]

        # what surrounds an element that is left is left as well
        return Elements([self.tags[i] for i in kept], [place[self.parents[i]] for i in kept], attributes), kept


_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def attributes_of(token: str) -> dict[str, str]:
    """Attributes of a start tag, names in small letters; of one name the last counts, one without value is ''."""
    out = {}
    for m in _ATTRIBUTE.finditer(token, re.match(r"<[^\s/>]*", token).end()):
        value = m[2] or ""
        value = value[1:-1] if value[:1] in ('"', "'") else value
        if "&" in value:
            for ref, char in COMMON_REFERENCES.items():
                value = value.replace(ref, char)
        out[m[1].lower()] = value
    return out


def selected(page: Page, tokens: list[str], fields: list[tuple[str, str]]) -> tuple[list[tuple], list[str]]:
    """(hits, unsupported): the first element of each field's selector, and the fields whose selector is not built."""
    elements, kept = page.live(tokens)
    hits, unsupported = [], []
    for field, text in fields:
        selector = compiled(text) if text is not None else None
        if selector is None:
            unsupported.append(field)
            continue
        first = first_match(selector, elements)
        if first is not None:
            row = page.rows[kept[first]]
            hits.append((field, row[0], row[5], row[6]))
    return hits, sorted(unsupported)


def _as_list_array(pages: list[np.ndarray], names: tuple[str, ...]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, pages)])
    flat = np.concatenate([np.zeros((0, len(names)), np.int32), *pages])
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=list(names))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


_HITS = pa.list_(pa.struct([(n, pa.string() if n == "field" else pa.int32()) for n in _HIT]))


def _laid_out(columns: tuple[pa.Array, ...], fields: pa.Array | None, tokens: pa.Array | None) -> pa.Array:
    elems, texts, mains, by_density, hits, unsupported = [], [], [], [], [], []
    for i, row in enumerate(zip(*columns, strict=True)):  # Python objects of one page at a time
        page = Page(*(c.as_py() for c in row))
        elems.append(np.array(page.elem_rows(), np.int32).reshape(-1, len(_ELEM)))
        texts.append(np.array(page.text_rows(), np.int32).reshape(-1, len(_TEXT)))
        mains.append(page.main and {"pos": page.main[0], "end": page.main[1], "t_from": page.main[5], "t_to": page.main[6]})
        by_density.append(page.by_density)
        wanted = fields[i].as_py() if fields is not None else None
        found, other = (None, None) if wanted is None else selected(page, tokens[i].as_py(), wanted)
        hits.append(found and [dict(zip(_HIT, h, strict=True)) for h in found])
        unsupported.append(other)
    main = pa.array(mains, pa.struct([(n, pa.int32()) for n in _MAIN]))
    return pa.StructArray.from_arrays(
        [_as_list_array(elems, _ELEM), _as_list_array(texts, _TEXT), main, pa.array(by_density, pa.bool_()),
         pa.array(hits, _HITS), pa.array(unsupported, pa.list_(pa.string()))],
        names=LAYOUT_TYPE.names,
    )


@F.arrow_udf(LAYOUT_TYPE)
def page_layout(kinds: pa.Array, names: pa.Array, sizes: pa.Array, text_sizes: pa.Array) -> pa.Array:
    return _laid_out((kinds, names, sizes, text_sizes), None, None)


@F.arrow_udf(LAYOUT_TYPE)
def selected_layout(kinds: pa.Array, names: pa.Array, sizes: pa.Array, text_sizes: pa.Array, fields: pa.Array, tokens: pa.Array) -> pa.Array:
    """The same for pages with selectors (a map, null for none) and their start tags."""
    return _laid_out((kinds, names, sizes, text_sizes), fields, tokens)


def depths_of(kinds: str, names: str, tags: list[str]) -> np.ndarray:
    """How many elements of each of ``tags`` enclose each token; its own start tag counts, its end tag does not."""
    column = {t: k for k, t in enumerate(tags)}
    out = np.zeros((len(kinds), len(tags)), np.int32)
    here = [0] * len(tags)
    stack: list[str] = []
    is_open: Counter[str] = Counter()
    tag_names = iter(names.split(" "))
    for pos, kind in enumerate(kinds):
        if kind == END_TAG:
            name = next(tag_names)
            while is_open[name]:
                last = stack.pop()
                is_open[last] -= 1
                if last in column:
                    here[column[last]] -= 1
                if last == name:
                    break
        elif kind == CODES[0]:
            name = next(tag_names)
            stack.append(name)
            is_open[name] += 1
            if name in column:
                here[column[name]] += 1
        out[pos] = here
    return out


def page_depths(tags: list[str]) -> Callable[..., Column]:
    """UDF ``(kinds, names) -> struct<d0: array<int>, ...>``: the depths of each token in each of ``tags``."""
    fields = [f"d{k}" for k in range(len(tags))]

    @F.arrow_udf(T.StructType([T.StructField(f, T.ArrayType(T.IntegerType())) for f in fields]))
    def depths(kinds: pa.Array, names: pa.Array) -> pa.Array:
        pages = [depths_of(k.as_py(), n.as_py(), tags) for k, n in zip(kinds, names, strict=True)]
        offsets = pa.array(np.cumsum([0, *map(len, pages)]), pa.int32())
        flat = np.concatenate([np.zeros((0, len(tags)), np.int32), *pages])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(c))) for c in flat.T], names=fields)

    return depths
