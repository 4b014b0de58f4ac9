import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagemill.operators import traversal as TR
from pagemill.operators.joins import skew_safe_join
from pagemill.session import materialize
from pagemill.options import CrawlOptions
from pagemill.plans.queries import ORACLE, QUERIES


def simulate(edges, seed, max_depth, max_pages, fetched, rejected=()):
    """First-in-first-out walk in plain Python."""
    queue, known, visited = deque([(seed, 0)]), {seed}, []
    while len(visited) < max_pages and queue:
        url, depth = queue.popleft()
        visited.append((url, depth))
        if url in fetched and depth < max_depth:
            for _, dst in sorted(edges.get(url, [])):
                if dst not in known and dst not in rejected:
                    known.add(dst)
                    queue.append((dst, depth + 1))
    return visited, len(queue)


@pytest.mark.parametrize("trial", range(3))
def test_equals_a_queue(spark, trial):
    rng = random.Random(trial)
    names = [f"http://n{i}.example.com/" for i in range(25)]
    rows = [(rng.choice(names), p, rng.choice(names)) for p in range(60)]
    rows += [(names[0], 99, names[0]), (names[1], 98, "http://x.example.com/a.pdf"), (names[0], 97, "http://x.example.com/a.pdf")]
    edges = {}
    for src, pos, dst in rows:
        edges.setdefault(src, []).append((pos, dst))
    depth, budget = [(3, 100), (3, 9), (2, 4)][trial]
    fetched = set(names[: 20 if trial else 25])
    walk = TR.traverse(
        spark.createDataFrame(rows, "src_url string, pos int, dst_url string"),
        spark.createDataFrame([(names[0],)], "url string"),
        depth, budget, options=CrawlOptions(names[0]),
        fetched=spark.createDataFrame([(u,) for u in fetched], "url string"),
    )
    expected, queued = simulate(edges, names[0], depth, budget, fetched, {"http://x.example.com/a.pdf"})
    assert [(r.url, r.depth) for r in TR.visit_order(walk.visited).collect()] == expected
    state = TR.crawl_state(walk, names[0]).first()
    assert (state.visited_count, state.queue_count) == (len(expected), queued)
    assert state.extracted_count == sum(u in fetched for u, _ in expected)
    assert (walk.n_visited, walk.n_queued) == (len(expected), queued) == (walk.visited.count(), walk.queued.count())
    assert TR.crawl_progress(walk, spark).orderBy(F.desc("depth")).first()[1:] == (len(expected), queued)


def test_levels_are_numbered_by_key(spark):
    rows = spark.range(500).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(1).alias("depth"), (F.col("id") * 37 % 500 - 250).cast("decimal(38,0)").alias("key"))
    level = TR.ranked_level(rows)
    assert level.n == 500 and level.n_bytes == sum(len(f"u{i}") for i in range(500))
    assert {r.url: r.rank for r in level.rows.collect()} == {f"u{i}": i * 37 % 500 for i in range(500)}
    assert TR.ranked_level(rows.limit(0)).n == 0


def test_plan_of_a_level(spark):
    """Candidates are reduced by hash aggregations of one number; nothing is sorted for it."""
    links = spark.createDataFrame([("a", 1, "b")], "src_url string, pos bigint, dst_url string")
    frontier = spark.createDataFrame([("a", 0, 0)], "url string, depth int, rank bigint")
    plan = TR.expand_level(frontier, links, small=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("HashAggregate") == 2


def test_state_of_a_site_with_very_many_labels(spark):
    n = 1_000_000
    urls = spark.range(n).select(F.concat(F.lit("http://s"), "id", F.lit(".example.com/")).alias("url"), F.lit(0).alias("depth"), F.col("id").alias("visit"), F.lit(True).alias("fetched"))
    walk = TR.Traversal(urls, urls.limit(0), n, 0)
    state = TR.crawl_state(walk, "http://www.example.com/")
    assert tuple(state.first()) == ("example.com", n, n, 0, n)
    assert "collect_set" not in state._jdf.queryExecution().executedPlan().toString()


def test_state_lists_the_labels(spark):
    hosts = ["b.example.com", "example.com", "a.example.com", "b.example.com", "é.example.com", None]
    rows = [(h and f"http://{h}/{i}", 0, i + 1, True) for i, h in enumerate(hosts)]
    urls = spark.createDataFrame(rows, "url string, depth int, visit long, fetched boolean")
    state = TR.crawl_state(TR.Traversal(urls, urls.limit(0), 6, 2), "http://www.example.com/", listed=True)
    assert state.columns == ["base_domain", "subdomains", "subdomain_count", "visited_count", "queue_count", "extracted_count"]
    assert tuple(state.first()) == ("example.com", ["a", "b", "é"], 3, 6, 2, 6)
    bare = TR.Traversal(urls.where("visit = 2"), urls.limit(0), 1, 0)
    assert tuple(TR.crawl_state(bare, "http://www.example.com/", listed=True).first()) == ("example.com", [], 0, 1, 0, 1)


SITE = [("http://m.example.com/a", "/w1", "/w2"), ("http://docs.example.com/b", "/w1"), ("http://api.example.com/c", "/w2"), ("http://late.example.com/d", "/w2")]
SITES = {
    "labels": (SITE, ("example.com", "api | docs | m | words", 4, 5, 1, 5)),
    "none": ([("http://example.com/a",), ("http://b.example.com/b", "/w1")], ("example.com", None, 0, 1, 0, 0)),
}


@pytest.mark.parametrize("name", ["crawl_state", "write_crawl_state"])
@pytest.mark.parametrize("site", SITES)
def test_query_of_the_state_equals_its_sql(spark, tmp_path, site, name):
    duckdb = pytest.importorskip("duckdb")
    docs, expected = SITES[site]
    rows = [(i, url, "<p>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</p>") for i, (url, *hrefs) in enumerate(docs)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    reference = duckdb.sql(ORACLE[name])
    state = QUERIES[name](spark, str(tmp_path))
    assert state.columns == reference.columns
    assert [tuple(r) for r in state.collect()] == reference.fetchall() == [expected]


def test_large_positions(spark):
    links = spark.createDataFrame([("a", 1 << 40, "b"), ("a", 1 << 41, "c")], "src_url string, pos bigint, dst_url string")
    walk = TR.reachable(links, spark.createDataFrame([("a",)], "url string"), 2, 2)
    assert [r.url for r in TR.visit_order(walk).collect()] == ["a", "b"]


def test_a_hot_key_of_equal_rows_is_split(spark):
    big = materialize(spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").otherwise(F.col("id").cast("string")).alias("k")), "big")
    small = spark.createDataFrame([("hot", 1)], "k string, v int")
    joined = skew_safe_join(big, small, "k", "left", broadcast=False)
    assert joined.agg(F.count(F.lit(1)), F.sum("v")).first() == (20_000, 19_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay apart
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these few rows would be sent to all tasks
    try:
        spread = joined.where("v = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(spread) > 1


def test_dedupe_keeps_the_first(spark):
    found = spark.createDataFrame([("a", 1, 5), ("a", 1, 2), ("b", 1, 1)], "url string, depth int, key bigint")
    known = spark.createDataFrame([("b",)], "url string")
    assert [(r.url, r.key) for r in TR.dedupe_frontier(found, known).collect()] == [("a", 2)]
