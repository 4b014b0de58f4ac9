"""Robots files as a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import strip


def robots_rules(robots: DataFrame) -> DataFrame:
    """``(host, line_no, agent, kind, path)`` from ``(host, body)``, one file per host.

    Lines are trimmed and lower-cased; blank lines, ``#`` lines and lines without a colon are
    skipped.  A ``user-agent`` line sets the group of the ``allow`` and ``disallow`` lines after it; rules
    before any agent and empty rules are ignored.  The window is bounded by one file.
    """
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("line_no", "line"))
    clean = lines.withColumn("line", F.lower(strip(F.col("line"))))
    clean = clean.where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")) & F.contains(F.col("line"), F.lit(":")))
    pairs = clean.select(
        "host",
        "line_no",
        strip(F.substring_index("line", ":", 1)).alias("kind"),
        strip(F.regexp_replace("line", r"^[^:]*:", "")).alias("path"),
    )
    so_far = Window.partitionBy("host").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("kind") == "user-agent", F.col("path")), ignorenulls=True).over(so_far)
    rules = pairs.withColumn("agent", agent)
    return rules.where(
        F.col("kind").isin("allow", "disallow") & (F.col("path") != "") & (F.col("agent") != "")
    ).select("host", "line_no", "agent", "kind", "path")
