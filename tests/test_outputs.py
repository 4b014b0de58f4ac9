import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.operators.links import link_degrees, link_graph, orphan_pages
from pagemill.operators.records import content_records
from pagemill.operators.traversal import Traversal, crawl_state
from pagemill.sinks import writers as W
from pagemill.sources.pages import load_pages, write_pages_table
from pagemill.streaming import content as S

PAGES = "page_id long, url string, html string"


def lines(path):
    return [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]


def test_jsonl_leaves_out_missing_fields(make_pages, tmp_path):
    W.write_content_jsonl(content_records(make_pages("<article>café</article>")), str(tmp_path / "c"))
    assert [json.loads(x) for x in lines(tmp_path / "c")] == [
        {"url": "http://www.example.com/dir/page0", "page_type": "article", "main_content": "café"}
    ]
    assert "café" in lines(tmp_path / "c")[0]


def test_sorted_lists(spark, tmp_path):
    urls = [f"http://e.com/{i}" for i in (3, 1, 2)] + ["http://e.com"]
    W.write_visited_urls(spark.createDataFrame([(u,) for u in urls], "url string"), str(tmp_path / "v"))
    assert lines(tmp_path / "v") == sorted(urls)


def test_state_is_written_with_its_labels(spark, tmp_path):
    urls = spark.createDataFrame([(f"http://{h}example.com/", 0, i, True) for i, h in enumerate(["b.", "", "a."], 1)], "url string, depth int, visit long, fetched boolean")
    for visited, labels in ((urls, ["a", "b"]), (urls.where("visit = 2"), [])):
        state = crawl_state(Traversal(visited, urls.limit(0), visited.count(), 4), "http://example.com/", listed=True)
        W.write_crawl_state(state, str(tmp_path / "s"))
        (line,) = lines(tmp_path / "s")
        n = visited.count()
        assert json.loads(line) == {
            "base_domain": "example.com", "subdomains": labels, "subdomain_count": len(labels), "visited_count": n, "queue_count": 4, "extracted_count": n
        }


def test_html_folder(spark, tmp_path):
    (tmp_path / "x.html").write_text("<p>a\nb</p>")
    row = load_pages(spark, str(tmp_path), "html").first()
    assert row.html == "<p>a\nb</p>" and row.url.endswith("x.html")


def test_graph(spark):
    links = spark.createDataFrame(
        [("http://a.e.com/", "http://e.com/x"), ("http://a.e.com/", "http://e.com/x"), ("http://e.com/x", "http://o.org/")], "src_url string, dst_url string"
    )
    graph = {(r.src_url, r.dst_url): (r.n, r.internal) for r in link_graph(links).collect()}
    assert graph[("http://a.e.com/", "http://e.com/x")] == (2, True) and graph[("http://e.com/x", "http://o.org/")] == (1, False)
    assert {r.url: (r.out_degree, r.in_degree) for r in link_degrees(links).collect()}["http://e.com/x"] == (1, 1)
    pages = spark.createDataFrame([(1, "http://e.com/x#f"), (2, "http://e.com/y")], "page_id long, url string")
    assert [r.page_id for r in orphan_pages(pages, links).collect()] == [2]


def test_regions_need_no_shuffle(spark, make_pages):
    from pagemill.operators import tokens as TK

    pages = make_pages("<p>a</p>", "<nav>b<nav>c</nav>d<footer>e</nav>f")
    for found in (TK.with_regions(pages, ["nav"]), TK.region_text(pages, ["nav", "footer"], "-")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    assert TK.with_regions(pages, ["nav"]).count() == 13
    assert {r.page_id: r.text for r in TK.region_text(pages, ["nav", "footer"], "-").collect()} == {0: "", 1: "b-c-d-e"}


def test_bucketed_pages_meet_without_a_shuffle(spark, make_pages):
    write_pages_table(make_pages("<p>a</p>", "<nav>b</nav>"), "bucketed_pages", 2)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.table("bucketed_pages")
        both = pages.join(pages.select("page_id", "url"), "page_id")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_pages")


def test_extraction_needs_no_shuffle(make_pages):
    plan = content_records(make_pages("<p>a</p>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    batches = [[(1, "u1", "<article>a</article>"), (2, "u2", "<main>b</main>")], [(3, "u3", "<h1>c</h1>"), (4, "u1", "<article>again</article>")]]
    for rows in batches:
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(str(src))
        S.stream_content(S.page_stream(spark, str(src), files_per_batch=1), out, f"{out}/checkpoint").awaitTermination()
    S.stream_content(S.page_stream(spark, str(src)), out, f"{out}/checkpoint").awaitTermination()
    batch = content_records(spark.createDataFrame(batches[0] + batches[1][:1], PAGES))
    found = sorted((r.url, r.title, r.main_content) for r in S.read_content(spark, out).collect())
    assert found == sorted((r.url, r.title, r.main_content) for r in batch.collect())
    states = sorted((r.batch_id, r.visited_count, r.extracted_count) for r in S.read_state(spark, out).collect())
    assert states[0][1:] == (2, 2) and states[-1][1:] == (3, 3)


def test_a_batch_that_failed_is_replayed(spark, tmp_path, monkeypatch):
    """It stops after its content and before its totals: readers don't see it, and its replay adds nothing twice."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    for rows in ([(1, "u1", "<main>a</main>")], [(2, "u2", "<main>b</main>"), (3, "u1", "<main>again</main>")]):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        S.stream_content(S.page_stream(spark, str(src), files_per_batch=1), out, f"{out}/checkpoint").awaitTermination()

    totals = S._totals
    monkeypatch.setattr(S, "_totals", lambda spark, out, batch_id: 1 / 0 if batch_id == 1 else totals(spark, out, batch_id))
    with pytest.raises(Exception, match="division by zero"):
        run()
    assert Path(out, "content", "batch_id=1").exists()
    assert [r.url for r in S.read_content(spark, out).collect()] == ["u1"]
    monkeypatch.undo()
    run()
    assert sorted((r.url, r.main_content) for r in S.read_content(spark, out).collect()) == [("u1", "a"), ("u2", "b")]
    assert max(tuple(r)[:2] for r in S.read_state(spark, out).collect()) == (2, 2)


def test_stream_with_types_and_selectors(spark, tmp_path):
    """The first readable set of a type holds for its pages of later batches as well."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    page = "<main><h2>one</h2><p class=x>two</p></main>"
    batches = [[(1, "a1", page), (2, "b1", page)], [(3, "a2", page), (4, "b2", page), (5, "c1", page)]]
    raws = {1: "broken", 2: '{"head": "h2"}', 3: '{"late": ".x"}', 4: '{"other": "p"}', 5: '{"gone": "i"}'}

    def replies(batch):
        raw = F.create_map(*[F.lit(x) for pair in raws.items() for x in pair])
        return batch.select("page_id", F.substring("url", 1, 1).alias("page_type"), F.array("page_id").alias("order_key"), raw[F.col("page_id").cast("int")].alias("raw"))

    analysis = spark.createDataFrame([(u, u[0]) for rows in batches for _, u, _ in rows], "url string, page_type string")
    for rows in batches:
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(str(src))
        stream = S.page_stream(spark, str(src), files_per_batch=1)
        S.stream_content(stream, out, f"{out}/checkpoint", analysis=analysis, selector_replies=replies, page_types=("a", "b")).awaitTermination()
    found = {r.url: (r.page_type, r.extra) for r in S.read_content(spark, out).collect()}
    assert found == {
        "a1": ("a", {"content": "onetwo"}), "b1": ("b", {"head": "one"}), "a2": ("a", {"late": "two"}), "b2": ("b", {"head": "one"}),
    }


def test_urls_are_forgotten_in_time(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "v", "c")], PAGES).coalesce(1).write.parquet(str(src))
    for k, age in enumerate([None, "30 days"]):
        once = S.stream_dedupe(S.page_stream(spark, str(src)), age).writeStream.format("parquet").option("path", str(tmp_path / f"o{k}"))
        once.option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / f"o{k}"))
        assert sorted(r.url for r in rows.collect()) == ["u", "v"] and rows.columns == ["page_id", "url", "html"]
