"""HTML expressions: token pattern, tag names, attributes, character references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.references import COMMON_REFERENCES

_INSIDE_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""

# One match per token: raw-text element, comment, character data section, tag, declaration, text.
# A ``<`` that starts none of these is text, so the tokens always cover the document.
# Possessive loops keep the matcher iterative on long input.
TOKEN_RE = (
    r"(?is)<(script|style)(?=[\s/>])" + _INSIDE_TAG + r".*?(?:</\1\s*+>|\z)"
    r"|<!--.*?-->|<!\[CDATA\[.*?\]\]>"
    r"|</?[a-z]" + _INSIDE_TAG + r"|<[!?/][^>]*+>"
    r"|<?[^<]++(?:<(?![a-z/!?])[^<]*+)*+|<"
)
TAG_RE = r"^</?([a-zA-Z][^\s/>]*)"
_ATTR_RE = r"""(?s)([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""

# Elements without content.
VOID_TAGS = [
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
    "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
]
RAW_TAGS = ["script", "style"]
# Elements whose strings do not belong to the text of the elements around them.
HIDDEN_TAGS = ["template", "rt", "rp"]

def html_tokens(doc: Column) -> Column:
    """All tokens of a document in order; joined they give the document back."""
    return F.regexp_extract_all(doc, F.lit(TOKEN_RE), F.lit(0))


def tag_name(tok: Column) -> Column:
    """Lower-case element name of a tag token, '' for any other token."""
    return F.lower(F.regexp_extract(tok, TAG_RE, 1))


def _is_cdata(tok: Column) -> Column:
    return tok.rlike(r"(?i)^<!\[CDATA\[")


def _self_closed(tok: Column) -> Column:
    """Ends in ``/>`` and the slash is not the end of an unquoted value."""
    return F.endswith(tok, F.lit("/>")) & ~tok.rlike(r"""=[^\s"'>]+/>$""")


def token_kind(tok: Column, tag: Column) -> Column:
    """``open``, ``close``, ``void`` (no content), ``raw`` (script, style), ``comment`` or ``text``."""
    return (
        F.when(~F.startswith(tok, F.lit("<")), F.lit("text"))
        .when(tag == "", F.when(tok.rlike(r"(?s)^<[!?/].*>$") & ~_is_cdata(tok), F.lit("comment")).otherwise(F.lit("text")))
        .when(tag.isin(RAW_TAGS) & ~F.startswith(tok, F.lit("</")), F.lit("raw"))  # an unclosed one reaches to the end
        .when(~F.endswith(tok, F.lit(">")), F.lit("text"))
        .when(F.startswith(tok, F.lit("</")), F.lit("close"))
        .when(tag.isin(VOID_TAGS) | _self_closed(tok), F.lit("void"))
        .otherwise(F.lit("open"))
    )


def _unquoted(value: Column) -> Column:
    quoted = F.startswith(value, F.lit('"')) | F.startswith(value, F.lit("'"))
    return F.when(quoted, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def attribute_names(tok: Column) -> Column:
    """Names of the attributes with a value of a tag token, in small letters, the last one first."""
    return F.reverse(F.regexp_extract_all(F.lower(tok), F.lit(_ATTR_RE), F.lit(1)))


def attribute_values(tok: Column) -> Column:
    """Undecoded values of the same attributes.

    Names and values come from one left-to-right scan each, so text that looks like an
    attribute inside a quoted value is not taken for one.
    """
    return F.reverse(F.transform(F.regexp_extract_all(tok, F.lit(_ATTR_RE), F.lit(2)), _unquoted))


def value_of(names: Column, values: Column, name: str) -> Column:
    """The value of an attribute in the two lists, NULL if there is none.  Of attributes of one name the last counts."""
    return F.get(values, F.array_position(names, name).cast("int") - 1)


def raw_attribute(tok: Column, name: str) -> Column:
    """Undecoded value of an attribute of a tag token, NULL if it has none."""
    return F.when(F.contains(F.lower(tok), F.lit(name)), value_of(attribute_names(tok), attribute_values(tok), name))


def has_class(classes: Column, name: str) -> Column:
    """Is ``name`` one of the white-space separated words of a class attribute?"""
    return F.coalesce(F.array_contains(F.split(classes, r"\s+"), name), F.lit(False))


def decode_references(c: Column) -> Column:
    """Decode the frequent character references; see ``functions.references`` for the others."""
    decoded = c
    for ref, char in COMMON_REFERENCES.items():
        decoded = F.replace(decoded, F.lit(ref), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def text_value(tok: Column) -> Column:
    """Characters of a text token."""
    section = F.regexp_replace(tok, r"(?s)^<!\[[A-Za-z]+\[|\]\]>$", "")
    return F.when(F.startswith(tok, F.lit("<![")), section).otherwise(decode_references(tok))


def attribute(tok: Column, name: str) -> Column:
    """Decoded value of an attribute of a tag token, NULL if it has none."""
    return decode_references(raw_attribute(tok, name))
