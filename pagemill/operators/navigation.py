"""Navigation links, sidebar sections and footer of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.html import has_class
from pagemill.functions.plan import kept
from pagemill.operators.document import elements, is_live, text_of

SIDEBAR_HEADING_TAGS = ["h2", "h3", "h4"]


def _live(elems: Column, mutated: bool) -> Column:
    return F.filter(elems, is_live) if mutated else elems


def _texts_inside(regions: Column, tags: list[str], mutated: bool) -> Column:
    """Texts of the given elements inside each region; nested regions repeat them."""
    keep = is_live if mutated else None
    inner = _live(elements(*tags), mutated)
    return F.flatten(
        F.transform(
            regions,
            lambda r: F.transform(
                F.filter(inner, lambda e: (e["pos"] > r["pos"]) & (e["pos"] < r["end"])),
                lambda e: text_of(e, keep=keep),
            ),
        )
    )


def _or_null(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


@kept
def nav_links(mutated: bool = False, css: bool = False) -> Column:
    """Non-empty anchor texts in every nav; ``css`` adds elements with the role ``navigation``."""
    regions = elements("nav")
    if css:
        regions = F.filter("elems", lambda e: (e["tag"] == "nav") | F.coalesce(e["role"] == "navigation", F.lit(False)))
    return _or_null(F.filter(_texts_inside(_live(regions, mutated), ["a"], mutated), lambda t: t != ""))


@kept
def sidebar_sections(mutated: bool = False, css: bool = False) -> Column:
    """Heading texts in every aside; ``css`` adds ``.sidebar`` and ``#sidebar``."""
    regions = elements("aside")
    if css:
        regions = F.filter(
            "elems",
            lambda e: (e["tag"] == "aside")
            | F.coalesce(e["ident"] == "sidebar", F.lit(False))
            | has_class(e["classes"], "sidebar"),
        )
    return _or_null(_texts_inside(_live(regions, mutated), SIDEBAR_HEADING_TAGS, mutated))


@kept
def footer_text(mutated: bool = False) -> Column:
    """Text of the first footer, NULL if there is none or it is empty."""
    first = F.get(_live(elements("footer"), mutated), F.lit(0))
    text = text_of(first, keep=is_live if mutated else None)
    return F.when(text != "", text)


def navigation_columns(mutated: bool = True, css: bool = False) -> dict[str, Column]:
    return {
        "nav_links": nav_links(mutated, css),
        "sidebar_sections": sidebar_sections(mutated, css),
        "footer": footer_text(mutated),
    }


def page_navigation(docs: DataFrame, mutated: bool = True, css: bool = False) -> DataFrame:
    """``(page_id, url, nav_links, sidebar_sections, footer)``.

    ``mutated``: as left over after main-content extraction; else of the whole page.
    """
    columns = navigation_columns(mutated, css)
    return docs.select("page_id", "url", *[c.alias(n) for n, c in columns.items()])
