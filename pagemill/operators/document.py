"""One row per page that the extraction operators project from.

``page_documents`` turns each page into its non-empty texts in order, the elements that matter with the range of
texts they enclose, and the main element.  Titles, headings, anchors, regions and samples are then
projections of that row.

The whole step is narrow: nothing is shuffled or sorted, so it scales with the scan, a hot host
does not matter, and a lost executor costs one split.  Its time is linear in the size of a page.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import layout as L
from pagemill.functions.plan import kept, with_settled
from pagemill.functions.references import with_common_references
from pagemill.functions.text import strip
from pagemill.operators import tokens as TK

# What is cut out of the main element.
CLEAN_TAGS = ["script", "style", "nav", "header", "footer"]
CLEAN_CLASSES = ["ad", "advertisement", "social-share"]

_ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?"""


def _attributes_length(tok: Column) -> Column:
    """Length of a start tag's attributes as `` name="value"``, values escaped; of one name the last counts."""
    inside = F.regexp_replace(tok, r"^<[^\s/>]*", "")
    names = F.regexp_extract_all(F.lower(inside), F.lit(_ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("n"), H.decode_references(F.regexp_replace(v, r"""^["']|["']$""", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["n"]))

    def size(p: Column) -> Column:
        marks = F.length(p["v"]) - F.length(F.translate(p["v"], "&<>", ""))
        amps = F.length(p["v"]) - F.length(F.replace(p["v"], F.lit("&"), F.lit("")))
        return F.length(p["n"]) + 4 + F.length(p["v"]) + 3 * marks + amps

    sizes = F.aggregate(last, F.lit(0), lambda s, p: s + size(p))
    return F.when(tok.rlike(r"\s"), sizes).otherwise(0)


def _serialized_length(tok: Column, x: Column) -> Column:
    """Length of a token in normalised markup: texts with &, < and > escaped, void tags as ``<br/>``."""
    text = H.text_value(tok)
    marks = F.length(text) - F.length(F.translate(text, "&<>", ""))
    amps = F.length(text) - F.length(F.replace(text, F.lit("&"), F.lit("")))
    bare = F.length(x["tag"]) + 1 + _attributes_length(tok)
    return (
        F.when(x["kind"] == "text", F.length(text) + 3 * marks + amps)
        .when(x["kind"] == "open", bare + 1)
        .when((x["kind"] == "void") & x["tag"].isin(H.VOID_TAGS), bare + 2)
        .when(x["kind"] == "void", bare + 4 + F.length(x["tag"]))
        .otherwise(F.length(tok))
    )


def _read(x: Column) -> Column:
    """Token with its text, and with the names and values of its attributes if some operator looks at one of them."""
    start = x["kind"].isin("open", "void") & F.contains(x["tok"], F.lit("="))
    wanted = start & x["tok"].rlike(r"""(?i)[\s"'](?:id|class|role|href)\s*=""")
    return F.struct(
        x["tag"], x["kind"],
        F.when(wanted, H.attribute_names(x["tok"])).alias("names"),
        F.when(wanted, H.attribute_values(x["tok"])).alias("values"),
        F.when(x["kind"] == "text", strip(H.text_value(x["tok"]))).alias("text"),
    )


def _with_attributes(x: Column) -> Column:
    def value(name: str) -> Column:
        return H.value_of(x["names"], x["values"], name).alias(name)

    href = F.when(x["tag"] == "a", H.decode_references(value("href"))).alias("href")
    return F.struct(x["tag"], x["kind"], x["text"], value("id").alias("ident"), value("class").alias("classes"), value("role"), href)


def _with_code(x: Column) -> Column:
    """Token with its rank as a main container and its code for the layout step."""
    prio = F.coalesce(TK.main_priority(x["tag"], x["ident"], x["role"], x["classes"]), F.lit(0))
    of_class = x["classes"].isNotNull() & F.arrays_overlap(F.split(x["classes"], r"\s+"), F.array(*[F.lit(c) for c in CLEAN_CLASSES]))
    cut = F.when(x["tag"].isin(CLEAN_TAGS) | of_class, L.CUT).otherwise(0)
    track = F.when(x["tag"].isin(TK.BLOCK_TAGS) | (prio > 0), L.TRACK).otherwise(0)
    code = 1 + track + cut + L.PRIO * prio + F.when(x["kind"] == "void", L.PRIO * L.RANKS).otherwise(0)
    start = F.substring(F.lit(L.CODES), code, F.lit(1))
    kind = (
        F.when(x["kind"] == "text", F.when(x["text"] != "", L.TEXT).otherwise(L.OTHER)).when(x["kind"] == "close", L.END_TAG)
        .when(x["kind"].isin("open", "void"), start).when(x["kind"] == "raw", L.RAW).otherwise(L.OTHER)
    )
    fields = [x[f] for f in ("tag", "kind", "text", "ident", "classes", "role", "href")]
    return F.struct(*fields, (prio > 0).alias("ranked"), kind.alias("code"))


def page_documents(pages: DataFrame, sizes: bool = False, selectors: bool = False) -> DataFrame:
    """``(page_id, url, texts, elems, metas, main, by_density)``, one row per page with content.

    ``texts``: ``(pos, text, gone, skipped)``.  ``elems``: the elements that some operator looks at, by position, with extent
    ``pos, end``, attributes, ``gone`` (taken out of the page by main-content extraction), region depths, and the
    text range ``t_from, t_to``.  ``metas``: ``(name, content)``.  ``main``: extent of the main element, NULL if there is none;
    ``by_density``: no known container exists, so the densest block counts.

    ``sizes`` gives every element its text and markup size outside header, footer, nav and aside; else pages with a known
    container go without.  ``selectors``: the pages have a column of this name (field to CSS selector, or NULL);
    then the row has ``hits`` (field, and the extent of its first element) and ``unsupported`` as well.
    """
    given = ["selectors"] if selectors else []
    e = _expressions(sizes, selectors)
    rows = TK.page_token_arrays(with_common_references(pages), given).select("page_id", "url", "toks", *given, e["toks"], e["metas"])
    # a column of its own: as an argument this expression keeps the optimizer from taking the UDF out
    rows = with_settled(rows, rows.columns, {"_markup": e["markup"]})
    return with_settled(rows.withColumn("_layout", e["layout"]), ["page_id", "url"], e["settled"])


@kept
def _expressions(sizes: bool, selectors: bool) -> dict[str, Any]:
    """The columns of :func:`page_documents`, each over those before it."""
    tagged = F.transform("toks", lambda t: F.struct(t.alias("tok"), F.when(F.startswith(t, F.lit("<")), H.tag_name(t)).otherwise(F.lit("")).alias("tag")))
    kinds = F.transform(tagged, lambda x: F.struct(x["tok"], x["tag"], H.token_kind(x["tok"], x["tag"]).alias("kind")))
    toks = F.transform(F.transform(F.transform(kinds, _read), _with_attributes), _with_code)
    named = F.filter("_toks", lambda x: x["kind"].isin("open", "close", "void", "raw"))
    shown = F.filter("_toks", lambda x: x["code"] == L.TEXT)
    markup = F.transform("toks", lambda t, i: _serialized_length(t, F.get("_toks", i)).cast("string"))
    needed = F.lit(True) if sizes else ~F.exists("_toks", lambda x: x["ranked"])
    columns = [
        F.array_join(F.transform("_toks", lambda x: x["code"]), ""),
        F.array_join(F.transform(named, lambda x: x["tag"]), " "),
        F.col("_markup"),
        F.when(needed, F.array_join(F.transform(shown, lambda x: F.length(x["text"]).cast("string")), " ")),
    ]
    layout = L.page_layout
    if selectors:
        start = F.transform("toks", lambda t, i: F.struct(t.alias("tok"), F.get("_toks", i)["kind"].alias("kind")))
        start = F.filter(start, lambda x: x["kind"].isin("open", "void", "raw"))
        tokens = F.transform(start, lambda x: F.when(x["kind"] == "raw", F.regexp_extract(x["tok"], "(?s)^<[^>]*>?", 0)).otherwise(x["tok"]))
        layout, columns = L.selected_layout, [*columns, F.col("selectors"), F.when(F.col("selectors").isNotNull(), tokens)]

    def token(x: Column, field: str) -> Column:
        return F.get(F.col("_toks"), x["pos"])[field]

    settled = {
        "texts": F.transform("_layout.texts", lambda t: F.struct(t["pos"], token(t, "text").alias("text"), t["gone"], t["skipped"])),
        "elems": F.transform(
            "_layout.elems",
            lambda e: F.struct(
                e["pos"], e["end"], *[token(e, f).alias(f) for f in ("tag", "ident", "classes", "role", "href")],
                e["gone"], e["around"], e["skipped"], e["t_from"], e["t_to"], e["text_len"], e["html_len"],
            ),
        ),
        "metas": F.transform(
            "_metas",
            lambda t: F.struct(H.attribute(t, "name").alias("name"), F.coalesce(H.attribute(t, "content"), F.lit("")).alias("content")),
        ),
    }
    settled |= {name: F.col(f"_layout.{name}") for name in ("main", "by_density", *(("hits", "unsupported") if selectors else ()))}
    return {
        "toks": toks.alias("_toks"),
        "metas": F.filter("toks", lambda t: t.rlike(r"(?i)^<meta[\s/>]")).alias("_metas"),
        "markup": F.when(needed, F.array_join(markup, " ")),
        "layout": layout(*columns),
        "settled": settled,
    }


@kept
def elements(*tags: str) -> Column:
    """Elements of the given names, in document order."""
    return F.filter("elems", lambda e: e["tag"].isin(list(tags)))


Keep = Callable[[Column], Column]


def is_live(x: Column) -> Column:
    """Is this text or element still on the page after main-content extraction took its parts out?"""
    return x["gone"] == 0


def joined(texts: Column, sep: str = "") -> Column:
    return F.array_join(F.transform(texts, lambda t: t["text"]), sep)


def text_of(elem: Column, sep: str = "", keep: Keep | None = None) -> Column:
    """All text of an element, or that of the entries ``keep`` accepts; '' if there is none."""
    inside = F.slice("texts", elem["t_from"], elem["t_to"] - elem["t_from"] + 1)
    return joined(F.filter(inside, keep) if keep else inside, sep)
