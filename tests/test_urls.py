from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators.traversal import subdomains_visited
from pagemill.operators.urls import url_facts

BASES = ["http://a.com/b/c/d;p?q", "http://a.com", "http://u:p@X.com:8080/a/b/?x=1#f", "mailto:x@y", "http://a.com/b//c/"]
HREFS = [
    "g", "./g", "g/", "/g", "//g", "?y", "g?y#s", "#s", ";x", "g;x?y#s", "", ".", "./", "..", "../g", "../..", "../../../g",
    "/./g", "/../g", "g.", "./../g", "g/./h", "g/../h", "http:g", "mailto:a@b", "HTTP://Q.com/x#", "http://q.com?", "//h2/x/../y",
    "a//b", "a b", "javascript:x", "x?a=b?c", "  /lead", "/t\tab", "ftp://z/y",
]


def test_resolve_and_defragment_agree_with_the_standard_library(spark):
    pairs = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b string, h string")
    found = U.with_defragmented(U.with_resolved(pairs, "b", "h", "r"), "r", "d").collect()
    for row in found:
        assert row.d == urlparse(urljoin(row.b, row.h))._replace(fragment="").geturl(), (row.b, row.h)


def test_domains(spark):
    cases = {
        "docs.example.io": ("example.io", "docs"),
        "a.b.example.co.uk": ("example.co.uk", "a.b"),
        "a.co.uk": ("a.co.uk", ""),
        "x.com.foo.io": ("foo.io", "x.com"),
        "localhost": ("localhost", ""),
        "u@Www.Example.com:8080": ("Example.com:8080", "u@Www"),
        "": ("", ""),
        "a_b.example.com": ("example.com", "a_b"),
    }
    rows = spark.createDataFrame([(n,) for n in cases], "n string")
    for row in rows.select("n", U.base_domain(F.col("n")).alias("b"), U.subdomain(F.col("n")).alias("s")).collect():
        assert (row.b, row.s) == cases[row.n]


def test_facts_and_visited_subdomains(spark):
    urls = spark.createDataFrame(
        [("https://docs.example.io",), ("https://docs.example.io/",), ("https://blog.example.io/a?x=1#f",), ("/rel",), ("https://Example.io/",)],
        "url string",
    )
    facts = {r.url: r for r in url_facts(urls, "https://example.io/").collect()}
    assert facts["/rel"].same_site and facts["https://docs.example.io"].same_site
    assert not facts["https://Example.io/"].same_site  # letter case counts
    assert facts["https://blog.example.io/a?x=1#f"].query == "x=1"
    assert sorted(r.subdomain for r in subdomains_visited(urls).collect()) == ["blog", "docs"]


def test_links_keep_bare_ampersands(spark, make_pages):
    from pagemill.operators.document import page_documents
    from pagemill.operators.links import extract_links, frontier_links

    html = (
        '<a href="/s?a=1&num=10&lang=en&order=2">1</a><a href="/t?a=1&copy=2&amp;x=3&#38;y=4&hellip;">2</a><a href="/one" href="/two">3</a>'
        '<a title="t"href="/near">4</a><script>var a = "<a href=\'/no\'>'
    )
    pages = make_pages(html)
    expected = ["/s?a=1&num=10&lang=en&order=2", "/t?a=1&copy=2&x=3&y=4…", "/two", "/near"]
    for found in (extract_links(pages), frontier_links(page_documents(pages))):
        assert [r.dst_url for r in found.orderBy("pos").collect()] == ["http://www.example.com" + e for e in expected]
