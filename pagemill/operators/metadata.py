"""Title, description, author, date and headings of a page (projections of ``page_documents``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.plan import kept
from pagemill.operators.document import elements, text_of

# Names of the meta elements that hold each field.
DESCRIPTION_NAMES = ("description",)
AUTHOR_NAMES = ("author", "article:author")
DATE_NAMES = ("date", "article:published_time")
HEADING_TAGS = ["h1", "h2", "h3"]


@kept
def title() -> Column:
    """Text of the first title element; of the first h1 only if there is no title element at all.

    NULL for an empty title and for one that holds markup.
    """
    first = F.get(elements("title"), F.lit(0))
    own = F.when(first["end"] - first["pos"] == 2, text_of(first))
    return F.when(first.isNotNull(), own).otherwise(text_of(F.get(elements("h1"), F.lit(0))))


@kept
def meta_content(names: tuple[str, ...]) -> Column:
    """``content`` of the first meta element with one of the names: NULL without one, '' without content."""
    return F.get(F.filter("metas", lambda m: m["name"].isin(list(names))), F.lit(0))["content"]


@kept
def headings() -> Column:
    """Texts of all headings in order, NULL if there are none."""
    found = elements(*HEADING_TAGS)
    return F.when(F.size(found) > 0, F.transform(found, lambda h: text_of(h)))


METADATA = {
    "title": title,
    "description": lambda: meta_content(DESCRIPTION_NAMES),
    "author": lambda: meta_content(AUTHOR_NAMES),
    "date": lambda: meta_content(DATE_NAMES),
    "headings": headings,
}


def page_metadata(docs: DataFrame) -> DataFrame:
    """``(page_id, url, title, description, author, date, headings)``."""
    return docs.select("page_id", "url", *[expr().alias(name) for name, expr in METADATA.items()])
