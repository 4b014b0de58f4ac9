"""Which URLs may be visited, and why not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.functions.plan import kept, with_settled
from pagemill.operators.joins import skew_safe_join
from pagemill.options import CrawlOptions

# Schemes that can be fetched, endings of files that are not pages,
# and path pieces of pages without content.
HTTP_SCHEMES = ["http", "https"]
ASSET_EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "gif", "css", "js", "xml", "json", "zip"]
UTILITY_PATHS = ["login", "signup", "register", "cart", "checkout", "account", "profile", "admin", "wp-admin"]

# Reasons in the order of the checks; the first that fails is reported.
REASONS = ["scheme", "scope", "excluded", "not_included", "robots", "asset", "utility"]


def is_http(scheme: Column) -> Column:
    return scheme.isin(HTTP_SCHEMES)


def in_scope(netloc: Column, options: CrawlOptions) -> Column:
    seed_netloc = _literal_netloc(options.start_url)
    if options.scope == "any":
        return F.lit(True)
    if options.scope == "host":
        return (netloc == "") | (netloc == F.lit(seed_netloc))
    return U.same_site(netloc, U.base_domain(F.lit(seed_netloc)))


def _literal_netloc(url: str) -> str:
    from urllib.parse import urlparse

    return urlparse(url).netloc


def found_in(url: Column, regexes: tuple[str, ...]) -> Column:
    """Is any of the patterns found anywhere in the URL?"""
    return reduce(lambda a, b: a | b, [url.rlike(r) for r in regexes], F.lit(False))


def not_asset(path: Column) -> Column:
    return ~path.rlike(r"\.(?:" + "|".join(ASSET_EXTENSIONS) + r")\z")


def not_utility(path: Column) -> Column:
    return ~path.rlike(r"(?i)/(?:" + "|".join(UTILITY_PATHS) + ")")


def with_robots_verdict(urls: DataFrame, rules: DataFrame | None, user_agent: str, out: str = "allowed") -> DataFrame:
    """Add whether the host's rules allow ``path`` (columns ``netloc`` and ``path`` are needed).

    The agent's own group is asked first, then ``*``; within a group an allow prefix wins over a
    disallow prefix, and a group without a match passes on.  Rules are one array per host, so a
    URL stays one row; the join holds for hosts with a large share of the URLs.
    """
    if rules is None:
        return urls.withColumn(out, F.lit(True))
    agents = [user_agent.lower(), "*"]
    rank = F.when(F.col("agent") == agents[0], 0).otherwise(1)
    deny = F.when(F.col("kind") == "allow", 0).otherwise(1)
    per_host = (
        rules.where(F.col("agent").isin(agents))
        .groupBy(F.col("host").alias("netloc"))
        .agg(F.collect_set(F.struct(rank.alias("rank"), deny.alias("deny"), "path")).alias("_rules"))
    )
    joined = skew_safe_join(urls, per_host, "netloc", "left")
    path = F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))
    hits = F.filter("_rules", lambda r: F.startswith(path, r["path"]))
    verdict = F.array_min(F.transform(hits, lambda r: F.struct(r["rank"], r["deny"])))["deny"]
    return joined.withColumn(out, F.coalesce(verdict == 0, F.lit(True))).drop("_rules")


def admit_urls(urls: DataFrame, options: CrawlOptions, rules: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Add ``admitted`` and ``reject_reason`` (NULL if admitted) to a URL table.

    Without robots rules (or with ``respect_robots=False``) this is one projection without shuffle.
    """
    # settled: a filter on the verdict would copy each part's pattern into every place that looks at the part
    own = ["_u_scheme", "_u_netloc", "_u_path"]
    parts = with_settled(U.with_url_parts(urls, url, "_u_"), urls.columns, {c: F.col(c) for c in own})
    if rules is not None and options.respect_robots:
        renamed = parts.withColumns({"netloc": F.col("_u_netloc"), "path": F.col("_u_path")})
        parts = with_robots_verdict(renamed, rules, options.user_agent, "_robots").drop("netloc", "path")
    else:
        parts = parts.withColumn("_robots", F.lit(True))
    judged = with_settled(parts, urls.columns, {"reject_reason": _reason(url, options)})
    return judged.withColumn("admitted", F.col("reject_reason").isNull())


@kept
def _reason(url: str, options: CrawlOptions) -> Column:
    """The first check that fails, NULL if none does."""
    scheme, netloc, path = F.col("_u_scheme"), F.col("_u_netloc"), F.col("_u_path")
    included = found_in(F.col(url), options.include_regexes) if options.include_regexes else F.lit(True)
    checks = [
        is_http(scheme),
        in_scope(netloc, options),
        ~found_in(F.col(url), options.exclude_regexes),
        included,
        F.col("_robots"),
        not_asset(path),
        not_utility(path),
    ]
    return F.coalesce(*[F.when(~check, F.lit(name)) for name, check in zip(REASONS, checks)], F.lit(None).cast("string"))


def admission_report(verdicts: DataFrame, url: str = "url") -> DataFrame:
    """``(host, reject_reason, n)``; rows of a large host are combined before the shuffle."""
    parts = U.with_url_parts(verdicts, url)
    return parts.groupBy(F.col("netloc").alias("host"), "reject_reason").agg(F.count(F.lit(1)).alias("n"))
