import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators import admission as A
from pagemill.operators import joins
from pagemill.options import CrawlOptions
from pagemill.sources.robots import robots_rules

SEED = "https://www.example.com/"


def reasons(spark, urls, rules=None, **options):
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: r.reject_reason for r in A.admit_urls(table, CrawlOptions(SEED, **options), rules).collect()}


def test_each_rule_and_their_order(spark):
    cases = {
        "https://a.example.com/x": None,
        "mailto:x@example.com": "scheme",
        "https://other.org/x": "scope",
        "https://a.example.com/skip/me.pdf": "excluded",
        "https://a.example.com/nope": "not_included",
        "https://a.example.com/x.pdf": "asset",
        "https://a.example.com/x.PDF": None,
        "https://a.example.com/x/Cartoon": "utility",
        "https://a.example.com/x?next=/login": None,
        "https://a.example.com/x.pdf;v=1": "asset",
    }
    assert reasons(spark, cases, include_patterns=["/x", "me"], exclude_patterns=["skip"]) == cases


def test_scope_and_glob(spark):
    urls = ["https://www.example.com/blog/a", "https://b.example.com/blog/a", "https://x.org/blog/a"]
    assert list(reasons(spark, urls, scope="any").values()) == [None] * 3
    assert list(reasons(spark, urls, scope="host").values()) == [None, "scope", "scope"]
    glob = reasons(spark, urls, include_patterns=["*/blog/*"], pattern_kind="glob")
    assert glob[urls[0]] is None
    with pytest.raises(ValueError, match="glob"):
        CrawlOptions(SEED, include_patterns=["*/blog/*"])


def test_options_from_a_configuration_file():
    options = CrawlOptions.from_mapping({"start_url": SEED, "stay_on_subdomains": False, "delay_range": [1, 2], "max_pages": 5})
    assert (options.scope, options.max_pages) == ("any", 5)
    with pytest.raises(TypeError):
        CrawlOptions.from_mapping({"start_url": SEED, "bogus": 1})


ROBOTS = """Disallow: /early
# note
User-agent: Pagemill/1.0
Allow: /open/a
Disallow: /open
Disallow:
User-agent: first
User-agent: *
Disallow: /closed # inline
Disallow: /private
Allow: /private/ok
no colon here
"""


@pytest.fixture(scope="module")
def rules(spark):
    return robots_rules(spark.createDataFrame([("h.com", ROBOTS.replace("\n", "\r\n"))], "host string, body string"))


def test_robots_rules(rules):
    found = [(r.agent, r.kind, r.path) for r in rules.orderBy("line_no").collect()]
    assert found == [
        ("pagemill/1.0", "allow", "/open/a"),
        ("pagemill/1.0", "disallow", "/open"),
        ("*", "disallow", "/closed # inline"),
        ("*", "disallow", "/private"),
        ("*", "allow", "/private/ok"),
    ]


ALLOWED = {
    "http://h.com/open/a1": True, "http://h.com/open/b": False, "http://h.com/private": False, "http://h.com/private/ok": True,
    "http://h.com/closed": True, "http://h.com": True, "http://other.com/open/b": True, "http://h.com/Open": True,
}


@pytest.mark.parametrize("broadcast", [True, False])
def test_robots_verdict(spark, rules, broadcast, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda small: broadcast)
    urls = U.with_url_parts(spark.createDataFrame([(u,) for u in ALLOWED], "url string"), "url")
    found = {r.url: r.allowed for r in A.with_robots_verdict(urls, rules, "Pagemill/1.0").collect()}
    assert found == ALLOWED


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        salted = joins.skew_safe_join(big, small, "k", how, broadcast=False).select("k", "id", "v")
        plain = big.join(small, "k", how).select("k", "id", "v")
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
