"""Character references beyond the frequent ones.

Documents that hold such references are cut at them (and at their tags, which follow another rule), each reference is
looked up, and the pieces are joined again, all as column expressions.  The frequent ones stay and are
decoded by plain replaces.
"""

from __future__ import annotations

import html.entities
import json
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.plan import kept, with_settled

# References that are decoded by a plain replace.
COMMON_REFERENCES = {
    "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\xa0",
    "&copy;": "\xa9", "&middot;": "\xb7", "&amp;": "&",
}
_OTHERS = r"&(?!(?:" + "|".join(ref[1:-1] for ref in COMMON_REFERENCES) + r");)[#a-zA-Z]"

_REFERENCE = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*)"
_TAG_OR_REFERENCE = rf"<[a-zA-Z][^<>]*>|{_REFERENCE};?"
_CLOSED_REFERENCE = rf"{_REFERENCE};"
# How characters of markup are written, and the one that stands for what is no character.
_MARKUP = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
_NO_CHARACTER = "�"


def _windows_character(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


@lru_cache(maxsize=1)
def _names_as_json() -> str:
    """The named references of HTML by first letter, so that a look-up goes through few names."""
    table: dict[str, dict[str, str]] = defaultdict(dict)
    for name, chars in html.entities.html5.items():
        if name.endswith(";"):
            table[name[0]][name[:-1]] = _MARKUP.get(chars, chars)
    return json.dumps(table)


def _numbered(ref: Column) -> Column:
    """Character of a numeric reference, as HTML reads it."""
    hexadecimal = ref.rlike("^&#[xX]")
    digits = F.regexp_replace(F.regexp_extract(ref, "[0-9a-fA-F]+", 0), "^0+(?=.)", "")
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)
    code = F.when(F.length(digits) <= 7, code.cast("bigint")).otherwise(F.lit(1 << 32))
    windows = F.array(*[F.lit(_windows_character(c)) for c in range(0x80, 0xA0)])
    none = (
        (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F)
        | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    spelled = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    char = F.when(none, F.lit(_NO_CHARACTER)).when(code.between(0x80, 0x9F), F.get(windows, (code - 0x80).cast("int"))).otherwise(spelled)
    for plain, written in _MARKUP.items():
        char = F.when(code == ord(plain), F.lit(written)).otherwise(char)
    return char


def _character(ref: Column) -> Column:
    """Character of a reference, written as markup if it is such; NULL if there is no such name."""
    name = F.regexp_replace(ref, "^&|;$", "")
    names = F.from_json(F.lit(_names_as_json()), "map<string,map<string,string>>")
    named = F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    return F.when(F.startswith(name, F.lit("#")), _numbered(ref)).otherwise(named)


def _replaced(text: Column, pattern: str, replacement) -> Column:
    """``text`` with each match of ``pattern`` replaced by an expression of it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), replacement)
    between = F.split(text, pattern, -1)
    # one more piece than matches
    return F.array_join(F.zip_with(between, found, lambda piece, new: F.concat(piece, F.coalesce(new, F.lit("")))), "")


def attribute_value(value: Column) -> Column:
    """An attribute value with its closed references replaced; a bare ``&name`` is kept, as URLs hold such."""
    return _replaced(value, _CLOSED_REFERENCE, lambda ref: F.coalesce(_character(ref), ref))


def _in_text(found: Column) -> Column:
    # an unknown name is text, and loses its semicolon
    unknown = F.concat(F.lit("&amp;"), F.regexp_replace(found, "^&|;+$", ""))
    tag = F.when(F.contains(found, F.lit("&")), attribute_value(found)).otherwise(found)
    return F.when(F.startswith(found, F.lit("<")), tag).otherwise(F.coalesce(_character(found), unknown))


def with_characters(doc: Column) -> Column:
    """The document with its references replaced; inside tags only those with a semicolon count."""
    return _replaced(doc, _TAG_OR_REFERENCE, _in_text)


@kept
def _decoded(col: str, replaced: Callable[[Column], Column]) -> Column:
    return F.when(F.col(col).rlike(_OTHERS), replaced(F.col(col))).otherwise(F.col(col))


def _with_common(df: DataFrame, col: str, replaced: Callable[[Column], Column]) -> DataFrame:
    filled = df.where(F.length(col) > 0)
    # settled, so that the optimizer does not copy the column into its consumers, where it would
    # tokenise every page several times
    rest = [c for c in df.columns if c != col]
    return with_settled(filled, rest, {col: _decoded(col, replaced)})


def with_common_references(df: DataFrame, col: str = "html") -> DataFrame:
    """Rows whose document ``col`` has no character references but the frequent ones; empty ones are left out."""
    return _with_common(df, col, with_characters)


def with_common_attribute_references(df: DataFrame, col: str) -> DataFrame:
    """The same for a column of bare attribute values, under the rule for attributes."""
    return _with_common(df, col, attribute_value)
