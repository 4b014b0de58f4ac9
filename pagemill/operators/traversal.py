"""Breadth-first traversal of a stored link table under a depth and a page budget."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators.admission import admit_urls
from pagemill.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, hot_keys, skew_safe_join
from pagemill.options import CrawlOptions
from pagemill.session import discard, materialize

_WIDE = "decimal(38,0)"
_STEP = f"cast('{1 << 64}' AS decimal(20,0))"  # between the keys of two parents; link positions are 64-bit numbers


def _queue_key(rank: Column, pos: Column) -> Column:
    """Place in a first-in-first-out queue: by the parent's rank, then by the link's position.

    One number, so that the smallest key per target is found by a hash aggregation.
    """
    return (rank.cast("decimal(18,0)") * F.expr(_STEP) + pos.cast("decimal(20,0)")).cast(_WIDE)


def expand_level(frontier: DataFrame, links: DataFrame, small: bool | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``(url, depth, key)`` of the targets of a frontier's links, one row per target.

    ``frontier`` is ``(url, depth, rank)``, ``links`` is ``(src_url, pos, dst_url)``.  Keys sort as the targets do in a
    first-in-first-out queue.  The smallest key per target is found before rows meet in a shuffle, so popular
    targets do not pile up.  ``small`` and ``hot`` hand on what is known about the join (``skew_safe_join``).
    """
    sources = frontier.select(F.col("url").alias("src_url"), "depth", "rank")
    out = skew_safe_join(links.select("src_url", "pos", "dst_url"), sources, "src_url", "inner", broadcast=small, hot=hot)
    found = out.select(F.col("dst_url").alias("url"), (F.col("depth") + 1).alias("depth"), _queue_key(F.col("rank"), F.col("pos")).alias("key"))
    return found.groupBy("url").agg(F.min("depth").alias("depth"), F.min("key").alias("key"))


def dedupe_frontier(candidates: DataFrame, discovered: DataFrame) -> DataFrame:
    """Candidates ``(url, depth, key)`` that were not discovered before; of equal URLs the first stays."""
    first = candidates.groupBy("url").agg(F.min("depth").alias("depth"), F.min("key").alias("key"))
    return first.join(discovered.select("url"), "url", "left_anti")


@dataclass(frozen=True)
class Level:
    """A stored level ``(url, depth, rank)``: rank counts from 0 in queue order; ``n_bytes`` is the size of its URLs."""

    rows: DataFrame
    n: int
    n_bytes: int


def ranked_level(found: DataFrame) -> Level:
    """Store ``(url, depth, key)`` and number it by key.

    Range partitions are numbered each on its own; only their sizes reach the driver, so no task sees more than a range.
    """
    ranges = found.repartitionByRange("key", "url").withColumn("_range", F.spark_partition_id())
    stored = materialize(ranges, "level")
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)), F.sum(F.octet_length("url"))).collect()
    starts, n, n_bytes = {}, 0, 0
    for part, size, width in sorted(map(tuple, sizes)):
        starts[part], n, n_bytes = n, n + size, n_bytes + width
    within = F.expr("row_number() OVER (PARTITION BY _range ORDER BY key, url)")
    start = F.get(F.lit([starts.get(p, 0) for p in range(max(starts, default=0) + 1)]).cast("array<bigint>"), F.col("_range"))
    return Level(stored.select("url", "depth", (start + within - 1).cast("bigint").alias("rank")), n, n_bytes)


@dataclass(frozen=True)
class Traversal:
    """``visited``: ``(url, depth, visit, fetched)``, visit counts from 1 in the order of the visits; ``queued``: ``(url, depth)`` left over.

    The sizes of both are known; ``progress`` has (depth, visited so far, queue behind the level) for each level.
    """

    visited: DataFrame
    queued: DataFrame
    n_visited: int
    n_queued: int
    progress: list[tuple[int, int, int]] = field(default_factory=list)


def _followed(links: DataFrame, options: CrawlOptions | None, rules: DataFrame | None, fetched: DataFrame | None) -> DataFrame:
    """The links that a traversal can follow: from pages at hand to admitted targets.  Stored, as every level reads them."""
    found = links.select("src_url", F.col("pos").cast("bigint").alias("pos"), "dst_url")
    if fetched is not None:
        # Spark splits a page that has most of the links
        found = found.join(fetched.select(F.col("url").alias("src_url")).distinct(), "src_url", "left_semi")
    if options is not None:
        found = admit_urls(found, options, rules, url="dst_url").where("admitted").drop("admitted", "reject_reason")
    elif fetched is None:
        return found
    return materialize(found.select("src_url", "pos", "dst_url"), "followed")


def traverse(
    links: DataFrame,
    seeds: DataFrame,
    max_depth: int,
    max_pages: int,
    options: CrawlOptions | None = None,
    rules: DataFrame | None = None,
    fetched: DataFrame | None = None,
) -> Traversal:
    """Walk the link table from ``seeds(url)``, or ``seeds(url, pos)`` to order several, level by level.

    At most ``max_depth + 1`` rounds; each writes its new frontier to the shared folder, so a lost executor
    never repeats earlier rounds.  ``options`` admits targets (seeds are not checked).  ``fetched(url)`` are the pages at
    hand: others count as visited but yield no links.  Both are decided once, for the whole link table, which is
    then read once per level.
    """
    pos = F.col("pos").cast("bigint") if "pos" in seeds.columns else F.lit(0).cast("bigint")
    start = seeds.select("url", F.lit(0).alias("depth"), _queue_key(F.lit(0), pos).alias("key"))
    level = ranked_level(start.groupBy("url", "depth").agg(F.min("key").alias("key")))
    followed, hot = None, None
    discovered, visits, n_visited, progress = [level], [], 0, []
    queued: list[DataFrame] = []
    n_queued = 0
    for depth in range(max_depth + 1):
        if level.n == 0 or n_visited >= max_pages:
            queued.append(level.rows)
            n_queued += level.n
            break
        n_taken = min(level.n, max_pages - n_visited)
        taken = level.rows
        if n_taken < level.n:
            taken = level.rows.where(F.col("rank") < n_taken)
            queued.append(level.rows.where(F.col("rank") >= n_taken))
            n_queued += level.n - n_taken
        visits.append(taken.select("url", "depth", (F.col("rank") + n_visited + 1).alias("visit")))
        n_visited += n_taken
        if depth == max_depth:
            progress.append((depth, n_visited, n_queued))
            break
        if followed is None:
            followed = _followed(links, options, rules, fetched)
        small = n_taken <= BROADCAST_ROWS and level.n_bytes + 24 * n_taken <= BROADCAST_BYTES
        if not small and hot is None:
            hot = hot_keys(followed, "src_url")
        known = discovered[0].rows.select("url")
        for earlier in discovered[1:]:
            known = known.unionByName(earlier.rows.select("url"))
        level = ranked_level(dedupe_frontier(expand_level(taken, followed, small, hot), known))
        progress.append((depth, n_visited, n_queued + level.n))
        discovered.append(level)
    visited = visits[0] if visits else level.rows.limit(0).select("url", "depth", F.col("rank").alias("visit"))
    for more in visits[1:]:
        visited = visited.unionByName(more)
    if fetched is None:
        visited = visited.withColumn("fetched", F.lit(True))
    else:
        at_hand = fetched.select("url").distinct().withColumn("_at_hand", F.lit(True))
        visited = visited.join(at_hand, "url", "left").withColumn("fetched", F.col("_at_hand").isNotNull()).drop("_at_hand")
    left = queued[0] if queued else level.rows.limit(0)
    for more in queued[1:]:
        left = left.unionByName(more)
    if followed is not None and hasattr(followed, "stored_at"):
        discard(followed)  # the levels are stored
    return Traversal(visited.select("url", "depth", "visit", "fetched"), left.select("url", "depth"), n_visited, n_queued, progress)


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, **kwargs) -> DataFrame:
    """``(url, depth, visit, fetched)`` of the pages a traversal visits."""
    return traverse(links, seeds, max_depth, max_pages, **kwargs).visited


def visit_order(visited: DataFrame) -> DataFrame:
    """Visited pages in the order of the visits: level by level, then as they came into the queue."""
    return visited.orderBy("visit")


def subdomains_visited(visited: DataFrame) -> DataFrame:
    """Distinct non-empty subdomains of the visited URLs."""
    parts = U.with_url_parts(visited.select("url"), "url").select(U.subdomain(F.col("netloc")).alias("subdomain"))
    return parts.where(F.col("subdomain") != "").distinct()


def crawl_state(walk: Traversal, start_url: str, extracted: DataFrame | None = None, listed: bool = False) -> DataFrame:
    """One row: ``base_domain, subdomain_count, visited_count, queue_count, extracted_count``.

    ``listed`` adds ``subdomains``, the sorted distinct labels, behind the base domain.  One row then holds them all, at
    most one per visited page, so the page budget bounds it.  A walk without a budget may meet millions: there the table
    of ``subdomains_visited``, which ``write_subdomains`` writes, has them.  ``extracted`` are the content records; by
    default every fetched page yields one.
    """
    found = [F.count(F.lit(1)).alias("subdomain_count")]
    if listed:
        found.append(F.array_sort(F.collect_list("subdomain")).alias("subdomains"))
    labels = subdomains_visited(walk.visited).agg(*found)
    if extracted is None:
        done = walk.visited.agg(F.count(F.when(F.col("fetched"), 1)).alias("extracted_count"))
    else:
        done = walk.visited.select("url").join(extracted.select("url"), "url", "left_semi").agg(F.count(F.lit(1)).alias("extracted_count"))
    counts = labels.withColumn("_one", F.lit(1)).join(done.withColumn("_one", F.lit(1)), "_one")
    return counts.select(
        U.base_domain(F.lit(urlparse(start_url).netloc)).alias("base_domain"),
        *(["subdomains"] if listed else []),
        "subdomain_count",
        F.lit(walk.n_visited).cast("long").alias("visited_count"),
        F.lit(walk.n_queued).cast("long").alias("queue_count"),
        "extracted_count",
    )


def crawl_progress(walk: Traversal, spark) -> DataFrame:
    """``(depth, visited_count, queue_count)``: the state after each level."""
    return spark.createDataFrame(walk.progress, "depth int, visited_count long, queue_count long")
