"""A short sample of a page, as input for a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.plan import kept
from pagemill.functions.text import WS_CLASS, strip
from pagemill.operators.document import elements, joined, text_of
from pagemill.operators.metadata import HEADING_TAGS

# Limits of the sample (they are what a sample is).
TEXT_SCAN, TEXT_LIMIT, PROMPT_TEXT_LIMIT = 10000, 3000, 1000
LINK_LIMIT, LINK_TEXT_LIMIT = 20, 50
HEADING_LIMIT, HEADING_TEXT_LIMIT = 10, 100
STRUCTURE_PER_TAG, STRUCTURE_LIMIT = 5, 20
STRUCTURE_TAGS = ["main", "article", "section", "div", "header", "nav", "footer"]
NO_TITLE = "Untitled"


def _shown(x: Column) -> Column:
    return x["skipped"] == 0


def _sampled(*tags: str) -> Column:
    return F.filter(elements(*tags), _shown)


def _text(e: Column) -> Column:
    return text_of(e, keep=_shown)


def _first_links() -> Column:
    return F.slice(F.filter(_sampled("a"), lambda a: a["href"].isNotNull()), 1, LINK_LIMIT)


@kept
def text_sample(compat: bool = False) -> Column:
    """Start of the page text; with ``compat`` the text of the last sampled link, if there is a link."""
    page = F.substring(joined(F.filter("texts", _shown), "\n"), 1, TEXT_SCAN)
    if compat:
        links = _first_links()
        page = F.when(F.size(links) > 0, _text(F.element_at(links, -1))).otherwise(page)
    return F.substring(page, 1, TEXT_LIMIT)


@kept
def structure_sample() -> Column:
    """``tag#id`` or ``tag.class.class`` of the first elements with a class, by element name."""

    def label(e: Column) -> Column:
        words = F.regexp_replace(strip(e["classes"]), rf"{WS_CLASS}+", ".")
        return F.when(e["ident"] != "", F.concat(e["tag"], F.lit("#"), e["ident"])).otherwise(
            F.concat(e["tag"], F.lit("."), words)
        )

    per_tag = [
        F.transform(
            F.slice(F.filter(_sampled(tag), lambda e: e["classes"].isNotNull()), 1, STRUCTURE_PER_TAG), label
        )
        for tag in STRUCTURE_TAGS
    ]
    return F.slice(F.flatten(F.array(*per_tag)), 1, STRUCTURE_LIMIT)


@kept
def links_sample() -> Column:
    """``array<(href, text)>`` of the first links, those without text or target left out afterwards."""
    pairs = F.transform(_first_links(), lambda a: F.struct(a["href"], _text(a).alias("text")))
    kept = F.filter(pairs, lambda p: (p["href"] != "") & (p["text"] != ""))
    return F.transform(kept, lambda p: F.struct(p["href"], F.substring(p["text"], 1, LINK_TEXT_LIMIT).alias("text")))


@kept
def heading_sample() -> Column:
    """``array<(tag, text)>`` of the first headings."""
    return F.transform(
        F.slice(_sampled(*HEADING_TAGS), 1, HEADING_LIMIT),
        lambda h: F.struct(h["tag"], F.substring(_text(h), 1, HEADING_TEXT_LIMIT).alias("text")),
    )


@kept
def sample_title() -> Column:
    first = F.get(_sampled("title"), F.lit(0))
    own = F.when(first["end"] - first["pos"] == 2, _text(first))
    return F.when(first.isNotNull(), own).otherwise(F.lit(NO_TITLE))


def page_sample(docs: DataFrame, compat: bool = False) -> DataFrame:
    """``(page_id, url, title, text_sample, structure_sample, links_sample, headings)``."""
    return docs.select(
        "page_id",
        "url",
        sample_title().alias("title"),
        text_sample(compat).alias("text_sample"),
        structure_sample().alias("structure_sample"),
        links_sample().alias("links_sample"),
        heading_sample().alias("headings"),
    )
