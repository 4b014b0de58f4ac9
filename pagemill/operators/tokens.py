"""Pages to tokens, and the region depth of each token.

Nothing here is shuffled: what depends on nesting is computed within the row of the page.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import layout as L
from pagemill.functions.references import with_common_references
from pagemill.functions.text import strip

# Elements whose extent matters to some operator, whatever their attributes.
BLOCK_TAGS = [
    "article", "main", "section", "div", "header", "nav", "footer", "aside",
    "a", "h1", "h2", "h3", "h4", "title", "noscript", "svg",
] + H.HIDDEN_TAGS + H.RAW_TAGS

# Places where the main content is looked for, best first.
MAIN_TAGS = ["article", "main"]
MAIN_ROLES = ["main"]
MAIN_IDS = ["content", "main-content"]
MAIN_CLASSES = ["content", "main-content", "post-content", "article-content", "entry-content"]


def main_priority(tag: Column, ident: Column, role: Column, classes: Column) -> Column:
    """Rank of an element as a main-content container (1 is best), NULL if it is none."""
    tests = [tag == t for t in MAIN_TAGS]
    tests += [role == r for r in MAIN_ROLES]
    tests += [ident == i for i in MAIN_IDS]
    tests += [H.has_class(classes, c) for c in MAIN_CLASSES]
    return F.coalesce(*[F.when(test, F.lit(rank)) for rank, test in enumerate(tests, 1)])


def page_token_arrays(pages: DataFrame, others: Iterable[str] = ()) -> DataFrame:
    """``(page_id, url, toks)`` and the ``others`` of the columns: the tokens of each page, in order."""
    return pages.select("page_id", "url", *others, H.html_tokens(F.col("html")).alias("toks"))


def _exploded(arrays: DataFrame) -> DataFrame:
    # the outer form: for the inner one the optimizer derives a filter on the size of the array and
    # pushes it below the shuffle, where it tokenises every page a second time
    rows = arrays.select("page_id", "url", F.posexplode_outer("toks").alias("pos", "tok"))
    rows = rows.where(F.col("pos").isNotNull())
    tagged = rows.withColumn("tag", H.tag_name(F.col("tok")))
    return tagged.withColumn("kind", H.token_kind(F.col("tok"), F.col("tag")))


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: ``page_id, url, pos, tok, kind, tag``.  No shuffle."""
    return _exploded(page_token_arrays(pages.where(F.length("html") > 0)))


def _nested(pages: DataFrame, tags: list[str]) -> DataFrame:
    """``(page_id, url, _toks, _depths)``: tokens ``(tok, tag, kind)`` of each page, and the lists of their depths."""
    tagged = F.transform("toks", lambda t: F.struct(t.alias("tok"), H.tag_name(t).alias("tag")))
    kinds = F.transform(tagged, lambda x: F.struct(x["tok"], H.token_kind(x["tok"], x["tag"]).alias("kind"), x["tag"]))
    rows = page_token_arrays(pages.where(F.length("html") > 0)).select("page_id", "url", kinds.alias("_toks"))
    code = F.transform("_toks", lambda x: F.when(x["kind"] == "open", L.CODES[0]).when(x["kind"] == "close", L.END_TAG).otherwise(L.OTHER))
    names = F.transform(F.filter("_toks", lambda x: x["kind"].isin("open", "close")), lambda x: x["tag"])
    return rows.withColumn("_depths", L.page_depths(tags)(F.array_join(code, ""), F.array_join(names, " ")))


def with_regions(pages: DataFrame, tags: Iterable[str]) -> DataFrame:
    """``page_tokens`` with ``depth_<tag>``: how many elements of that name enclose the token.

    Its own start tag counts, its end tag does not.  The depths come from the tree of the page, whatever tags are missing or too
    many, and are computed within the row: no shuffle.
    """
    tags = list(tags)
    depths = [F.col(f"_depths.d{k}").alias(f"d{k}") for k in range(len(tags))]
    rows = _nested(pages, tags).select("page_id", "url", F.posexplode_outer(F.arrays_zip(F.col("_toks").alias("t"), *depths)).alias("pos", "x"))
    columns = [F.col(f"x.d{k}").alias(f"depth_{t.replace('-', '_')}") for k, t in enumerate(tags)]
    return rows.where(F.col("pos").isNotNull()).select("page_id", "url", "pos", "x.t.tok", "x.t.kind", "x.t.tag", *columns)


def with_texts(tokens: DataFrame) -> DataFrame:
    """Add ``text``: the decoded, stripped text of text tokens, '' for white space, NULL for markup."""
    return tokens.withColumn("text", F.when(F.col("kind") == "text", strip(H.text_value(F.col("tok")))))


def region_text(pages: DataFrame, tags: Iterable[str], sep: str) -> DataFrame:
    """Text of a region per page: ``(page_id, text)`` of the non-empty texts inside elements of the given names.

    One row for each page with content, '' without such text; texts inside nested regions count once.  No shuffle.
    """
    tags = list(tags)
    inside = F.transform(F.col("_depths.d0"), lambda d, i: d + sum((F.get(f"_depths.d{k}", i) for k in range(1, len(tags))), F.lit(0)) > 0)
    texts = F.zip_with("_toks", inside, lambda x, near: F.when(near & (x["kind"] == "text"), strip(H.text_value(x["tok"]))))
    rows = _nested(with_common_references(pages), tags)
    return rows.select("page_id", F.array_join(F.filter(texts, lambda t: t != ""), sep).alias("text"))


def token_tag_counts(tokens: DataFrame) -> DataFrame:
    """Tokens per kind and element name over the corpus."""
    return tokens.groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))
