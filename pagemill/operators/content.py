"""Main content of a page: the first known container, else the densest block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.layout import BLOCK_TAGS, LEAST_BLOCK_TEXT
from pagemill.functions.plan import kept
from pagemill.functions.text import collapse_blank_lines
from pagemill.operators.document import is_live, text_of


@kept
def main_text() -> Column:
    """Cleaned text of the main element, NULL if it has none."""
    text = collapse_blank_lines(text_of(F.col("main"), "\n", keep=is_live))
    return F.when(text != "", text)


def main_content(docs: DataFrame) -> DataFrame:
    """``(page_id, url, main_content, by_density)``.

    The container of the best rank wins, the first one of that rank.  Density (text length by markup
    length) decides only when no container exists; the first block wins a tie.
    """
    return docs.select("page_id", "url", main_text().alias("main_content"), "by_density")


def main_by_selector(docs: DataFrame) -> DataFrame:
    """``(page_id, main_content)`` of the pages that have a known container; '' if it is empty."""
    return docs.where(~F.col("by_density")).select("page_id", F.coalesce(main_text(), F.lit("")).alias("main_content"))


def main_by_density(docs: DataFrame) -> DataFrame:
    """``(page_id, main_content)`` of the pages without a known container; '' without a dense block."""
    return docs.where("by_density").select("page_id", F.coalesce(main_text(), F.lit("")).alias("main_content"))


def content_density(docs: DataFrame) -> DataFrame:
    """One row per scored block: ``(page_id, pos, tag, text_len, html_len, density)``; ``docs`` must have ``sizes``."""
    scored = F.filter(
        "elems",
        lambda e: e["tag"].isin(list(BLOCK_TAGS)) & (e["around"] == 0) & (e["text_len"] >= LEAST_BLOCK_TEXT) & (e["html_len"] > 0),
    )
    blocks = docs.select("page_id", F.explode_outer(scored).alias("b")).where(F.col("b").isNotNull())
    return blocks.select(
        "page_id", "b.pos", "b.tag", "b.text_len", "b.html_len", (F.col("b.text_len") / F.col("b.html_len")).alias("density")
    )
