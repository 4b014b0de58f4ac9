"""Tables derived from ``pages`` for operators whose own input the corpus does not hold.

Each is a deterministic function of the whole ``pages`` table, and the reference SQL states it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators.links import extract_links
from pagemill.session import materialize
from pagemill.sources.pages import load_pages, spread

SEED_URL = "http://www.example.com/"
WORD_HOST = "http://words.example.com"


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, dealt out if their one file has fewer row groups than the session has cores."""
    return spread(load_pages(spark, f"{sf_dir}/pages.parquet"))


def links_of(pages: DataFrame) -> DataFrame:
    """The link table, stored: graph queries read it several times, and plan over plain columns."""
    return materialize(extract_links(pages), "links")


def with_busy_hrefs(pages: DataFrame) -> DataFrame:
    """The pages with links as they are on the web: bare and escaped ampersands, names that look like references, fragments."""
    busy = F.regexp_replace("html", '<a href="/([^"/]+)"', '<a class="x"href="../$1/./s?a=1&num=10&lang=en&amp;x=2&order=$1&copy=3#f&amp;g"')
    return pages.withColumn("html", busy)


def urls_of(pages: DataFrame) -> DataFrame:
    """``(url)`` of all pages, of all link targets, and of three places of each page that may not be visited."""
    host = F.regexp_extract("url", "^[a-z]+://[^/]*", 0)
    more = F.explode(
        F.array(
            F.concat(F.lit("mailto:p"), "page_id", F.lit("@example.com")),
            F.concat(host, F.lit("/en/file"), "page_id", F.lit(".pdf")),
            F.concat(host, F.lit("/fr/Cartoon/"), "page_id", F.lit("?next=a.pdf")),
        )
    )
    return pages.select("url").unionByName(links_of(pages).select(F.col("dst_url").alias("url"))).unionByName(pages.select(more.alias("url")))


def enriched(pages: DataFrame) -> DataFrame:
    """The pages with meta elements, a sidebar, and parts inside the article that extraction takes out again."""
    odd = F.col("page_id") % 2 == 1
    author = F.when(odd, F.lit("<meta name=author content=B>")).otherwise(
        F.lit("""<META content='A "x" &copy;' name="article:author"><meta name="author" content="late">""")
    )
    day = F.concat(F.lit('<meta name="article:published_time" content="2024-01-'), F.col("page_id") % 28 + 1, F.lit('">'))
    date = F.when(F.col("page_id") % 3 == 1, day).when(F.col("page_id") % 3 == 2, F.lit('<meta name="date">')).otherwise(F.lit('<meta property="date" content="no">'))
    head = F.concat(F.lit('<meta name="description" content="About &amp; '), _segment(2), F.lit('">'), author, date, F.lit("</head>"))
    side = F.concat(F.lit('<aside class="sidebar"><h2>Side <i>'), _segment(2), F.lit("</i></h2><p>x</p><h4>Sub</h4><aside><h3>in</h3></aside></aside>"))
    cut = F.lit('<article><div class="x ad">cut<p>cut</div><script>var a="</article>";</script><nav><a href="/cut">cut</a></nav><header>cut</header>')
    html = F.replace(F.replace("html", F.lit("</head>"), head), F.lit("<article>"), F.concat(side, cut))
    return pages.withColumn("html", html)


def _segment(n: int) -> Column:
    return F.regexp_extract("url", rf"^[a-z]+://[^/]*/{'[^/]*/' * (n - 1)}([^/?#]*)", 1)


def robots_of(pages: DataFrame) -> DataFrame:
    """``(host, body)``: one file per host, built from the URL and the links of its page with the smallest id."""
    parts = U.with_url_parts(pages, "url")
    rules = F.transform(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), lambda h: F.concat(F.lit("Disallow: "), h))
    body = F.concat(
        F.lit("# rules\r\nDisallow: /before\nUser-agent: *\nAllow: /"), _segment(1), F.lit("/"), F.substring(_segment(2), 1, 1),
        F.lit("\nDisallow: /"), _segment(1), F.lit("/\n\nUser-Agent: Pagemill/1.0\nAllow: /t\nDisallow:\n"), F.array_join(rules, "\n"),
    )
    return parts.groupBy(F.col("netloc").alias("host")).agg(F.min_by(body, "page_id").alias("body"))


def _reply_type() -> Column:
    u = F.col("url")
    return (
        F.when(u.endswith(".html"), "article").when(u.endswith("/"), "listing").when(u.contains("?page="), "category")
        .when(u.endswith("#top"), "product").otherwise("home")
    )


def _as_reply(body: Column) -> Column:
    """The same content fenced, bare-fenced, plain or broken in three ways, by the language in the URL."""
    lang, kind = _segment(1), F.length("url") % 3
    broken = F.when(kind == 0, F.concat(F.lit("Sorry: "), body)).when(kind == 1, F.concat(body, F.lit(" trailing }"))).otherwise(F.concat(body, body))
    return (
        F.when(lang == "en", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(lang == "fr", F.concat(F.lit("```\n"), body, F.lit("\n```\n")))
        .when(lang == "de", body)
        .otherwise(broken)
    )


def analysis_replies(pages: DataFrame) -> DataFrame:
    """``(page_id, url, raw)``: one classification reply per page."""
    body = F.concat(
        F.lit('{"page_type": "'), _reply_type(), F.lit('", "is_content_page": true, "content_value": "high", "has_item_list": '),
        F.when(_reply_type().isin("listing", "category"), "true").otherwise("false"),
        F.lit(', "estimated_items": '), F.length("url").cast("string"), F.lit("}"),
    )
    return pages.select("page_id", "url", _as_reply(body).alias("raw"))


def selector_replies(pages: DataFrame) -> DataFrame:
    """``(page_id, url, page_type, order_key, raw)``: one selector reply per page."""
    body = F.concat(
        F.lit('{"headline": "article h1", "lede": "article p", "promo": "div.ad", "nothing": "#x'), F.length("url").cast("string"), F.lit('"}')
    )
    return pages.select(
        "page_id", "url", _reply_type().alias("page_type"), F.array(F.col("page_id")).alias("order_key"), _as_reply(body).alias("raw")
    )


def word_graph(pages: DataFrame) -> DataFrame:
    """``(src_url, pos, dst_url)``: pages and the words they link to, in both directions.

    Links of the corpus lead to no page of it; through the words a traversal goes on.
    """
    links = links_of(pages)
    edges = U.with_defragmented(
        links.select("src_page_id", "src_url", "pos", F.concat(F.lit(WORD_HOST), F.col("href")).alias("word")), "src_url", "page"
    )
    there = edges.select(F.col("page").alias("src_url"), "pos", F.col("word").alias("dst_url"))
    back = edges.select(F.col("word").alias("src_url"), F.col("src_page_id").alias("pos"), F.col("page").alias("dst_url"))
    return there.unionByName(back.distinct())


def first_page_url(pages: DataFrame) -> str:
    """Defragmented URL of the page of ``example.com`` with the smallest id."""
    own = U.with_defragmented(U.with_url_parts(pages.select("page_id", "url"), "url"), "url", "clean")
    own = own.where(U.base_domain(F.col("netloc")) == "example.com")
    return own.agg(F.min_by("clean", "page_id")).first()[0]
