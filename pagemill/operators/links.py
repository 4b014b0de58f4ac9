"""Links of pages, and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import urls as U
from pagemill.functions.plan import with_settled
from pagemill.functions.references import with_common_attribute_references
from pagemill.operators.document import elements, is_live, text_of
from pagemill.operators.tokens import page_token_arrays


def _followable(href: Column) -> Column:
    return (href != "") & ~F.startswith(href, F.lit("javascript:")) & (href != "#")


def _resolved(anchors: DataFrame) -> DataFrame:
    """``(src_page_id, src_url, pos, href, dst_url)`` from ``(page_id, url, pos, href)``."""
    links = anchors.where(_followable(F.col("href")))
    targets = U.with_defragmented(U.with_resolved(links, "url", "href", "_target"), "_target", "dst_url")
    named = targets.withColumnsRenamed({"page_id": "src_page_id", "url": "src_url"})
    return with_settled(named, ["src_page_id", "src_url", "pos", "href"], {"dst_url": F.col("dst_url")})


def extract_links(pages: DataFrame) -> DataFrame:
    """Every link of every page in document order, duplicates kept; no shuffle.

    Empty targets, ``javascript:`` and a bare ``#`` are skipped; targets are resolved against the
    page's URL and lose their fragment.
    """
    tokens = page_token_arrays(pages.where(F.length("html") > 0)).select(
        "page_id", "url", F.posexplode_outer("toks").alias("pos", "tok")
    )
    anchors = tokens.where(F.col("tok").rlike(r"^<[aA][\s/]")).withColumn("href", H.raw_attribute(F.col("tok"), "href"))
    decoded = with_common_attribute_references(anchors, "href").withColumn("href", H.decode_references(F.col("href")))
    return _resolved(decoded.select("page_id", "url", "pos", "href"))


def frontier_links(docs: DataFrame) -> DataFrame:
    """The links that are still on the page after main-content extraction took its parts out."""
    live = F.filter(elements("a"), lambda a: a["href"].isNotNull() & is_live(a))
    anchors = docs.select("page_id", "url", F.explode_outer(live).alias("a")).where(F.col("a").isNotNull())
    return _resolved(anchors.select("page_id", "url", "a.pos", "a.href"))


def link_anchors(docs: DataFrame) -> DataFrame:
    """``(page_id, pos, href, text)``: the text of each link."""
    texts = F.transform(elements("a"), lambda a: F.struct(a["pos"], a["href"], text_of(a).alias("text")))
    anchors = docs.select("page_id", F.explode_outer(texts).alias("a")).where(F.col("a.href").isNotNull())
    return anchors.select("page_id", "a.pos", "a.href", "a.text")


def link_graph(links: DataFrame) -> DataFrame:
    """``(src_url, dst_url, n, internal)``: distinct edges with multiplicity; internal means same base domain."""
    edges = links.groupBy("src_url", "dst_url").agg(F.count(F.lit(1)).alias("n"))
    ends = U.with_url_parts(U.with_url_parts(edges, "src_url", "s_"), "dst_url", "d_")
    internal = U.base_domain(F.col("s_netloc")) == U.base_domain(F.col("d_netloc"))
    return ends.select("src_url", "dst_url", "n", internal.alias("internal"))


def link_degrees(links: DataFrame) -> DataFrame:
    """``(url, out_degree, in_degree)`` over distinct edges.

    Each edge adds one row to both of its ends and one grouping sums them; rows of a popular
    target are combined before the shuffle.
    """
    edges = links.select("src_url", "dst_url").distinct()
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src_url").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst_url").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy("e.url").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``(page_id, url)`` of pages that no link points to (URLs compared without fragment)."""
    own = U.with_defragmented(pages.select("page_id", "url"), "url", "dst_url")
    targets = links.select("dst_url").distinct()
    return own.join(targets, "dst_url", "left_anti").select("page_id", "url")
