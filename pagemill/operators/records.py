"""Content records: what is kept of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.plan import with_settled
from pagemill.operators.content import main_text
from pagemill.operators.document import page_documents
from pagemill.operators.metadata import METADATA
from pagemill.operators.models import page_type_filter, selected_texts, with_page_type, with_selectors
from pagemill.operators.navigation import navigation_columns
from pagemill.options import CrawlOptions

RECORD_FIELDS = [
    "url", "page_type", "title", "description", "author", "date", "headings",
    "main_content", "nav_links", "sidebar_sections", "footer",
]


def content_records(
    pages: DataFrame,
    analysis: DataFrame | None = None,
    selectors: DataFrame | None = None,
    page_types: tuple[str, ...] | None = None,
    options: CrawlOptions | None = None,
) -> DataFrame:
    """``(page_id, url, page_type, ..., extra)``: one record per page with content, NULL where a field is missing.

    ``analysis`` is ``(url, page_type)``; ``selectors`` is ``(page_id, selectors)`` for the pages that have
    an analysis, its fields fill ``extra`` where the record has no field of that name.  This is one pass over
    ``pages``, narrow but for the joins with the two tables: the selectors meet the raw pages, the types the records.  ``page_types``, or else those of ``options``, are the types to keep.
    """
    if page_types is None and options is not None:
        page_types = options.page_types
    if selectors is not None:
        pages = with_selectors(pages, selectors)
    fields = {name: expr() for name, expr in METADATA.items()}
    fields["main_content"] = main_text()
    fields |= navigation_columns(mutated=True)
    if selectors is not None:
        fields["_selected"] = selected_texts()
    docs = page_documents(pages, selectors=selectors is not None)
    records = with_page_type(with_settled(docs, ["page_id", "url"], fields), analysis)
    extra = F.lit(None).cast("map<string,string>")
    if selectors is not None:
        # a record field of the same name wins; fields that no record has are always taken
        present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in RECORD_FIELDS]))
        extra = F.map_filter("_selected", lambda k, v: ~F.array_contains(present, k))
    records = records.select("page_id", *RECORD_FIELDS, extra.alias("extra"))
    return page_type_filter(records, page_types)


def training_export(records: DataFrame) -> DataFrame:
    """``(url, title, text)`` of the records that have main content."""
    return records.where(F.col("main_content").isNotNull()).select("url", "title", F.col("main_content").alias("text"))
