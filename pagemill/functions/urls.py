"""URL expressions: split, resolve, base domain.  No Python worker is involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.plan import kept

# RFC 3986, appendix B, with the scheme's own character set.
URL_RE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Second-level labels that belong to a country suffix.
SECOND_LEVEL_LABELS = ["co", "com", "org", "net", "ac", "gov"]

# Schemes whose last path segment may carry ``;params``, schemes
# that allow relative references, and schemes that have a network location.
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms", "sftp", "tel"]
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
NETLOC_SCHEMES = RELATIVE_SCHEMES + ["telnet", "snews", "rsync", "nfs", "git", "git+ssh", "itms-services"]

_PARTS = ("scheme", "netloc", "path", "params", "query", "fragment")


def _cleaned(url: Column) -> Column:
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


@kept
def _part_columns(url: str, prefix: str) -> list[dict[str, Column]]:
    raw, col = f"_{prefix}raw_path", f"_{prefix}url"
    has_params = F.contains(F.col(raw), F.lit(";")) & F.col(f"{prefix}scheme").isin(PARAM_SCHEMES)
    return [
        {col: _cleaned(F.col(url))},
        {
            f"{prefix}scheme": F.lower(F.regexp_extract(col, URL_RE, 1)),
            f"{prefix}netloc": F.regexp_extract(col, URL_RE, 2),
            raw: F.regexp_extract(col, URL_RE, 3),
            f"{prefix}query": F.regexp_extract(col, URL_RE, 4),
            f"{prefix}fragment": F.regexp_extract(col, URL_RE, 5),
        },
        {
            f"{prefix}path": F.when(has_params, F.regexp_replace(raw, r";[^/]*$", "")).otherwise(F.col(raw)),
            f"{prefix}params": F.when(has_params, F.regexp_extract(raw, r";([^/]*)$", 1)).otherwise(F.lit("")),
        },
    ]


def with_url_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add ``scheme, netloc, path, params, query, fragment`` of a URL column; absent parts are ''.

    The columns are added in stages, so that later stages refer to plain columns and no
    pattern is evaluated twice.
    """
    for columns in _part_columns(url, prefix):
        df = df.withColumns(columns)
    return df.drop(f"_{prefix}raw_path", f"_{prefix}url")


def url_join(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    """Put the parts together again; empty parts leave no delimiter behind."""
    rooted = F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    bare = F.startswith(path, F.lit("//")) | (
        (scheme != "") & scheme.isin(NETLOC_SCHEMES) & ((path == "") | F.startswith(path, F.lit("/")))
    )
    hier = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted))
        .when(bare, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        hier,
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def with_defragmented(df: DataFrame, url: str, out: str, canonical: bool = False) -> DataFrame:
    """Add ``url`` without its fragment.  Query, trailing slash and letter case stay as they are.

    ``canonical=True`` also lower-cases the host and gives a bare host the path ``/``.
    """
    parts = with_url_parts(df, url, "_d_")
    return parts.withColumn(out, _defragmented(canonical)).drop(*[f"_d_{p}" for p in _PARTS])


@kept
def _defragmented(canonical: bool) -> Column:
    netloc, path = F.col("_d_netloc"), F.col("_d_path")
    if canonical:
        path = F.when((netloc != "") & (path == ""), F.lit("/")).otherwise(path)
        netloc = F.lower(netloc)
    return url_join(F.col("_d_scheme"), netloc, path, F.col("_d_params"), F.col("_d_query"), F.lit(""))


def _without_dots(segments: Column) -> Column:
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    return F.when(ends_in_dots, F.concat(walked, F.array(F.lit("")))).otherwise(walked)


def with_resolved(df: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """Add the absolute URL of ``href`` as found on the page ``base``."""
    staged = with_url_parts(with_url_parts(df, base, "_b_"), href, "_h_")
    for columns in _resolving(base, href, out):
        staged = staged.withColumns(columns)
    temps = [f"_{s}_{p}" for s in "bh" for p in _PARTS]
    return staged.drop(*temps, "_scheme", "_joined", "_merged", "_netloc", "_path", "_params", "_query")


@kept
def _resolving(base: str, href: str, out: str) -> list[dict[str, Column]]:
    """The columns of :func:`with_resolved`, in stages."""
    b = {p: F.col(f"_b_{p}") for p in _PARTS}
    h = {p: F.col(f"_h_{p}") for p in _PARTS}
    base_dir = F.regexp_replace(b["path"], r"[^/]*$", "")
    joined = F.when(F.startswith(h["path"], F.lit("/")), h["path"]).otherwise(
        F.regexp_replace(F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), h["path"]), r"/+", "/")
    )
    first = {"_scheme": F.when(h["scheme"] == "", b["scheme"]).otherwise(h["scheme"]), "_joined": joined}
    dotted = F.col("_joined").rlike(r"(?:^|/)\.\.?(?:/|$)")
    undotted = F.array_join(_without_dots(F.split("_joined", "/", -1)), "/")
    second = {"_merged": F.when(dotted, undotted).otherwise(F.col("_joined"))}
    scheme = F.col("_scheme")
    merged = F.when(F.col("_merged") == "", F.lit("/")).otherwise(F.col("_merged"))

    own_host = (h["netloc"] != "") & scheme.isin(NETLOC_SCHEMES)
    same_document = (h["path"] == "") & (h["params"] == "")
    path = F.when(own_host, h["path"]).when(same_document, b["path"]).otherwise(merged)
    params = F.when(~own_host & same_document, b["params"]).otherwise(h["params"])
    query = F.when(~own_host & same_document & (h["query"] == ""), b["query"]).otherwise(h["query"])
    third = {"_netloc": F.when(own_host, h["netloc"]).otherwise(b["netloc"]), "_path": path, "_params": params, "_query": query}
    foreign = (scheme != b["scheme"]) | ~scheme.isin(RELATIVE_SCHEMES)
    rebuilt = url_join(
        scheme, F.col("_netloc"), F.col("_path"), F.col("_params"), F.col("_query"), h["fragment"]
    )
    resolved = (
        F.when(F.col(base) == "", F.col(href))
        .when(F.col(href) == "", F.col(base))
        .when(foreign, F.col(href))
        .otherwise(rebuilt)
    )
    return [first, second, third, {out: resolved}]


def _base_size(labels: Column) -> Column:
    n = F.size(labels)
    country = (n > 2) & F.get(labels, n - 2).isin(SECOND_LEVEL_LABELS)
    return F.least(n, F.when(country, 3).otherwise(2))


def base_domain(netloc: Column) -> Column:
    """Last two labels of the network location, or three under a country suffix such as ``co.uk``."""
    labels = F.split(netloc, r"\.", -1)
    k = _base_size(labels)
    return F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")


def subdomain(netloc: Column) -> Column:
    """Labels in front of the base domain, '' if there are none."""
    labels = F.split(netloc, r"\.", -1)
    return F.array_join(F.slice(labels, F.lit(1), F.size(labels) - _base_size(labels)), ".")


def same_site(netloc: Column, seed_base: str | Column) -> Column:
    """True for a relative URL, or when the base domains are equal (case counts)."""
    seed = F.lit(seed_base) if isinstance(seed_base, str) else seed_base
    return (netloc == "") | (base_domain(netloc) == seed)
