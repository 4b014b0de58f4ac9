"""Page classifications and selectors that come as a table of model replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.plan import kept
from pagemill.functions.text import strip
from pagemill.operators.document import is_live, page_documents, text_of
from pagemill.operators.joins import skew_safe_join
from pagemill.operators.sampling import PROMPT_TEXT_LIMIT, page_sample

FENCE = "```"
DEFAULT_PAGE_TYPE = "article"

# The analysis that stands in for a reply that cannot be read.
FALLBACK_ANALYSIS = {
    "page_type": "unknown",
    "is_content_page": False,
    "content_value": "low",
    "has_item_list": False,
    "estimated_items": 0,
}
# Selectors for page types without a readable reply.
BASIC_SELECTORS = {"title": "h1", "content": "article, .content, main, #content, #main"}
LIST_SELECTORS = {
    "_list": ".products li, .product-list .product, .items .item",
    "item_title": ".title, h2, h3",
}
FALLBACK_SELECTORS = {
    "article": {"author": ".author, .byline", "date": ".date, time, .published-date"},
    "product": {"price": ".price, .product-price", "description": ".description, .product-description"},
    "listing": LIST_SELECTORS,
    "category": LIST_SELECTORS,
}


def without_fence(raw: Column) -> Column:
    """The reply without a Markdown code fence around it."""
    text = strip(raw)
    after_json = F.get(F.split(text, FENCE + "json", -1), F.lit(1))
    return (
        F.when(F.startswith(text, F.lit(FENCE + "json")), strip(F.substring_index(after_json, FENCE, 1)))
        .when(F.startswith(text, F.lit(FENCE)), strip(F.get(F.split(text, FENCE, -1), F.lit(1))))
        .otherwise(text)
    )


_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


def _is_object(body: Column) -> Column:
    """Is the whole text one JSON object?  The reader stops after the first value, so text after it needs a look.

    Within brackets such text could only go unseen by closing the bracket, within braces by closing
    the brace; it cannot do both.
    """
    braces = F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}"))
    one = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    wrapped = F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), "v string, _bad string", _JSON)
    return braces & F.coalesce(one, F.lit(False)) & wrapped["_bad"].isNull()


def parse_analysis(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the fields of a classification reply and ``parsed``; a reply that is no JSON object gives the fallback."""
    fields = ["page_type", "is_content_page", "content_value", "has_item_list", "estimated_items"]
    schema = ", ".join(f"{f} string" for f in fields) + ", _bad string"
    read = replies.withColumn("_body", without_fence(F.col(raw))).withColumn("_json", F.from_json("_body", schema, _JSON))
    good = F.coalesce(_is_object(F.col("_body")) & F.col("_json._bad").isNull(), F.lit(False))
    types = {"is_content_page": "boolean", "has_item_list": "boolean", "estimated_items": "int"}
    columns = {
        f: F.when(F.col("parsed"), F.col(f"_json.{f}").try_cast(types.get(f, "string"))).otherwise(F.lit(FALLBACK_ANALYSIS[f]))
        for f in fields
    }
    return read.withColumn("parsed", good).withColumns(columns).drop("_body", "_json")


def _fallback_selectors(page_type: Column) -> Column:
    def literal(table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    chosen = F.lit(None)
    for kind, extra in FALLBACK_SELECTORS.items():
        chosen = F.when(page_type == kind, literal(BASIC_SELECTORS | extra)).otherwise(chosen)
    return F.coalesce(chosen, literal(BASIC_SELECTORS))


def parse_selectors(replies: DataFrame, raw: str = "raw", page_type: str = "page_type") -> DataFrame:
    """Add ``selectors`` (field to CSS selector) and ``parsed``; an unreadable reply gives the type's fallback."""
    read = replies.withColumn("_body", without_fence(F.col(raw)))
    # a map schema has no place for the corrupt text, so validity comes from a struct without fields of interest
    bad = F.from_json("_body", "_bad string", _JSON)["_bad"].isNotNull()
    good = F.coalesce(_is_object(F.col("_body")) & ~bad, F.lit(False))
    parsed = read.withColumn("parsed", good)
    from_reply = F.from_json("_body", "map<string,string>", {"allowSingleQuotes": "false"})
    return parsed.withColumn(
        "selectors", F.when(F.col("parsed"), from_reply).otherwise(_fallback_selectors(F.col(page_type)))
    ).drop("_body")


def selectors_per_type(parsed: DataFrame, order: str = "order_key") -> DataFrame:
    """``(page_type, selectors, since)``: the first readable selector set of each page type."""
    good = parsed.where("parsed")
    return good.groupBy("page_type").agg(F.min_by("selectors", order).alias("selectors"), F.min(order).alias("since"))


def selectors_for_pages(parsed: DataFrame, order: str = "order_key") -> DataFrame:
    """Replace each page's own set: from the first readable set of its type on, that one; before it, the fallback."""
    cached = selectors_per_type(parsed, order).withColumnRenamed("selectors", "_cached")
    joined = skew_safe_join(parsed, cached, "page_type", "left")
    use = F.when(F.col(order) >= F.col("since"), F.col("_cached")).otherwise(_fallback_selectors(F.col("page_type")))
    return joined.withColumn("selectors", use).drop("_cached", "since")


def with_page_type(pages: DataFrame, analysis: DataFrame | None) -> DataFrame:
    """Add ``page_type`` by URL; a page without a reply, or whose reply names none, is an article.

    A reply that cannot be read names ``unknown`` (see ``parse_analysis``).  Of several replies for a URL the
    first type in alphabetical order counts.
    """
    if analysis is None:
        return pages.withColumn("page_type", F.lit(DEFAULT_PAGE_TYPE))
    types = analysis.groupBy("url").agg(F.min("page_type").alias("_type"))  # one reply for each URL
    typed = pages.join(types, "url", "left")
    return typed.withColumn("page_type", F.coalesce("_type", F.lit(DEFAULT_PAGE_TYPE))).drop("_type")


def page_type_filter(records: DataFrame, page_types: tuple[str, ...] | None) -> DataFrame:
    """Keep the listed page types; all of them if there is no list."""
    return records if page_types is None else records.where(F.col("page_type").isin(list(page_types)))


def analysis_input(docs: DataFrame, compat: bool = False) -> DataFrame:
    """``(page_id, url, input)``: the page sample as JSON text, for any batch classifier."""
    sample = page_sample(docs, compat).withColumn("text_sample", F.substring("text_sample", 1, PROMPT_TEXT_LIMIT))
    fields = ["url", "title", "headings", "structure_sample", "links_sample", "text_sample"]
    return sample.select("page_id", "url", F.to_json(F.struct(*fields)).alias("input"))


def classify(docs: DataFrame, classifier: Callable[[DataFrame], DataFrame], compat: bool = False) -> DataFrame:
    """Run a caller's classifier over ``analysis_input`` and read its replies.

    ``classifier`` takes ``(page_id, url, input)`` and returns ``(url, raw)``; it may be any DataFrame
    code, such as a pandas UDF over ``input``.
    """
    return parse_analysis(analysis_input(docs, compat).transform(classifier))


def with_selectors(pages: DataFrame, per_page: DataFrame, how: str = "left") -> DataFrame:
    """Add each page's ``selectors`` from ``(page_id, selectors)``, one row per page; raw pages are smaller than their structure."""
    return skew_safe_join(pages.select("page_id", "url", "html"), per_page.select("page_id", "selectors"), "page_id", how)


@kept
def selected_texts() -> Column:
    """For each field the text of the first element its selector finds; needs ``page_documents`` with selectors."""
    texts = F.transform("hits", lambda h: F.struct(h["field"].alias("field"), text_of(h, keep=is_live).alias("text")))
    return F.map_from_entries(texts)


def apply_selectors(pages: DataFrame, per_page: DataFrame) -> DataFrame:
    """``(page_id, extra, unsupported)``: for each selector field the text of its first matching element.

    ``per_page`` is ``(page_id, selectors)``.  Elements taken out by main-content extraction are no part of the tree.
    Supported are names, classes, ids, attribute tests, comma lists, descendants, ``>``, ``+``, ``~``, places among siblings
    (``:first-child``, ``:nth-of-type(2n+1)`` and the like), ``:not()``, ``:is()`` and ``:where()``.  ``unsupported`` names the
    fields with another selector; a field without a match is left out of ``extra``.
    """
    docs = page_documents(with_selectors(pages, per_page, "inner"), selectors=True).where(F.col("hits").isNotNull())
    return docs.select("page_id", selected_texts().alias("extra"), "unsupported")
