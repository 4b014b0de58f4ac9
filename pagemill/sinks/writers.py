"""Outputs of a crawl, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.records import RECORD_FIELDS


def content_json(records: DataFrame) -> DataFrame:
    """``(value)``: each record as one JSON object, record fields first, then the extra fields beside them."""
    fields = F.to_json(F.struct(*[F.col(c) for c in RECORD_FIELDS if c in records.columns]))
    if "extra" not in records.columns:
        return records.select(fields.alias("value"))
    more = F.when(F.size("extra") > 0, F.to_json("extra"))
    both = F.concat(fields.substr(F.lit(1), F.length(fields) - 1), F.when(fields != "{}", F.lit(",")).otherwise(F.lit("")), F.substr(more, F.lit(2)))
    return records.select(F.coalesce(both, fields).alias("value"))


def write_content_jsonl(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8; missing fields are left out, extra fields stand beside the others."""
    content_json(records).write.mode(mode).text(path)


def write_content_snapshot(records: DataFrame, path: str) -> None:
    """The whole result as a JSON lines data set that replaces the previous one."""
    write_content_jsonl(records, path, mode="overwrite")


def write_visited_urls(visited: DataFrame, path: str) -> None:
    """Sorted URLs, one per line; part files in name order are the sorted list."""
    visited.select("url").orderBy("url").write.mode("overwrite").text(path)


def write_subdomains(subdomains: DataFrame, path: str) -> None:
    """Sorted distinct labels, one per line."""
    subdomains.select("subdomain").distinct().orderBy("subdomain").write.mode("overwrite").text(path)


def write_crawl_state(state: DataFrame, path: str) -> None:
    """The summary row as one JSON object, replaced each time."""
    state.write.mode("overwrite").json(path)


def raw_html(pages: DataFrame) -> DataFrame:
    """``(html_id, url, html)`` with an id that follows from the URL."""
    return pages.where(F.length("html") > 0).select(F.sha2("url", 256).alias("html_id"), "url", "html")


def write_raw_html(pages: DataFrame, path: str) -> None:
    """Raw documents as Parquet, keyed by a hash of the URL."""
    raw_html(pages).write.mode("overwrite").parquet(path)
