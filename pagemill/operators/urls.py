"""URL facts of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls as U


def url_facts(urls: DataFrame, seed_url: str, url: str = "url") -> DataFrame:
    """Add the URL's parts, ``base_domain``, ``subdomain`` and ``same_site`` with respect to the seed; no shuffle."""
    from urllib.parse import urlparse

    seed = U.base_domain(F.lit(urlparse(seed_url).netloc))
    return U.with_url_parts(urls, url).withColumns(
        {
            "base_domain": U.base_domain(F.col("netloc")),
            "subdomain": U.subdomain(F.col("netloc")),
            "same_site": U.same_site(F.col("netloc"), seed),
        }
    )
