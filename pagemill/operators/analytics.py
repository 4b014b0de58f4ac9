"""Reports over a corpus: site structure and domain summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls as U


def site_structure(pages: DataFrame) -> DataFrame:
    """Page counts per host, first and second path segment, with subtotals.

    ``level`` is 0 for the finest rows, 1 for ``(host, segment1)``, 3 per host and 7 overall.  Also ``max_depth``, the
    largest number of path segments.  Counts are combined before the shuffle.
    """
    parts = U.with_url_parts(pages.select("url"), "url")
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = parts.withColumn("segments", segments).select(
        F.col("netloc").alias("host"),
        F.coalesce(F.get("segments", F.lit(0)), F.lit("")).alias("segment1"),
        F.coalesce(F.get("segments", F.lit(1)), F.lit("")).alias("segment2"),
        F.size("segments").alias("depth"),
    )
    return rows.rollup("host", "segment1", "segment2").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_pages"), F.max("depth").alias("max_depth")
    )


def domain_summary(records: DataFrame) -> DataFrame:
    """Per base domain: pages, distinct subdomains, main-content length, and how many have each field.

    Two steps: per subdomain first, so a domain with most of the pages is still spread and pre-combined.
    """
    parts = U.with_url_parts(records, "url")
    fields = ["title", "description", "author", "date", "headings", "main_content"]
    sums = {f"with_{f}": F.col(f).isNotNull().cast("long") for f in fields}
    sums["content_chars"] = F.coalesce(F.length("main_content"), F.lit(0)).cast("long")
    per_sub = (
        parts.withColumns({"base_domain": U.base_domain(F.col("netloc")), "subdomain": U.subdomain(F.col("netloc"))})
        .groupBy("base_domain", "subdomain")
        .agg(F.count(F.lit(1)).alias("n_pages"), *[F.sum(c).alias(n) for n, c in sums.items()])
    )
    named = F.sum((F.col("subdomain") != "").cast("long"))
    totals = per_sub.groupBy("base_domain").agg(
        F.sum("n_pages").alias("n_pages"), named.alias("n_subdomains"), *[F.sum(n).alias(n) for n in sums]
    )
    mean = F.round(F.col("content_chars") / F.col("with_main_content"), 6)
    return totals.withColumn("mean_content_chars", F.when(F.col("with_main_content") > 0, mean))
