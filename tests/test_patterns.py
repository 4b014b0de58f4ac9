"""URL patterns: what ``re.search`` finds, Spark finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions.patterns import spark_regex
from pagemill.operators.admission import found_in
from pagemill.options import CrawlOptions, as_regex

URLS = [
    "https://e.com/en/a", "https://e.com/fr/naïé", "https://e.com/DE/x_1", "https://e.com/a&&b/[c]", "https://e.com/²/x", "https://e.com/x\n", "https://e.com/x\r",
    "https://e.com/x\x85y", "https://e.com/x ", "https://e.com/٣٤", "https://e.com/a{2}/aa", "https://e.com/ſ/K", "", "a b#c", "x\x1cy", "x\xa0y", "éa", "https://e.com/en/en",
    "tab\there", "https://e.com/p?q=1&r=2#top", "https://e.com/12/3", "bell\x07", "\U0001f511/key",
]
PATTERNS = [
    "/(?P<l>en|fr)/", r"/(?P<lang_1>en)/(?P=lang_1)$", r"/\w+é$", r"/\W", r"\d\d", r"\D$", r"\s", r"\S+", r"\bx\b", r"\Bx", r"x$", r"x\Z", r"\Ahttps", r"^a", "(?i)/de/", "(?i)k", "(?a)\\d{2}",
    "[[]c[]]", "[&&]b", "[a&&b]{2}", r"[^\w/:.]", r"[\W\d]", r"[\s]", r"a{2}", r"a{,2}/a", "{", "a}", r"/x.", r"(?s)x.", "(?m)x$", r"\x2f\x64", r"é", r"\U0001f511", r"\N{KEY}", r"\07", r"[\b]|\t",
    r"(?x) / en  # language" + "\n /", r"[ #]", "(?:a|b)+/", "(?=.*r=2)q", "(?<=q=)1", "(?<!e)n", "(?i:EN)/", "a*?b", "a++", "(?>a+)/", "(e)n/\\1", "()\\1e", r"[]a]", r"[^]a]$", r"\.com/[0-9]+", r"\-|\#|\&", "(?#note)x", r"[a\]]",
    r"(/e)(n)\2?\1?", "é|ï", "[À-ÿ]", r"\101", "(?i)ſ", "(?ai)k", r"[\x00-\x1f]", r"(?:)", "$", "^$",
]


def test_patterns_agree_with_re(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "i int, url string")
    found = table.select("i", *[found_in(F.col("url"), (as_regex(p),)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).collect()
    for row in found:
        for k, p in enumerate(PATTERNS):
            assert row[f"p{k}"] == bool(re.search(p, URLS[row.i])), (p, spark_regex(p), URLS[row.i])


def test_random_patterns_agree_with_re(spark):
    rng = random.Random(1)
    atoms = ["a", "é", ".", r"\w", r"\W", r"\s", r"\d", "[a-f]", r"[^\w]", r"\b", "/", "x", "(?:en|fr)", r"[\d_-]", "$", "^", "(a)", "(?P<n>x)?"]
    patterns = []
    while len(patterns) < 150:
        p = "".join(rng.choice(atoms).replace("<n>", f"<n{i}>") + rng.choice(["", "", "?", "{1,2}"]) for i in range(rng.randint(1, 5)))
        try:
            re.compile(p)
            patterns.append(p)
        except re.error:
            pass
    texts = ["".join(rng.choice("aéx/_-1 \n\tenfr²") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, url string")
    for row in table.select("i", *[F.col("url").rlike(spark_regex(p)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect():
        for k, p in enumerate(patterns):
            assert row[f"p{k}"] == bool(re.search(p, texts[row.i])), (p, spark_regex(p), texts[row.i])


def test_bad_patterns_are_refused_early(spark):
    for bad in ("*/blog/*", "(", "(a)?(?(1)b|c)", "[a", "(?P<x>a)(?P<x>b)", "(?<=a+)b"):
        with pytest.raises(ValueError):
            CrawlOptions("https://e.com/", include_patterns=[bad])


def test_globs(spark):
    options = CrawlOptions("https://e.com/", include_patterns=["*/en/?", "https://e.com/a&&b/[[]c]"], pattern_kind="glob")
    table = spark.createDataFrame([(u,) for u in URLS], "url string")
    found = {r.url for r in table.where(found_in(F.col("url"), options.include_regexes)).collect()}
    assert found == {"https://e.com/en/a"}
