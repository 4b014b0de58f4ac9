"""Line deduplication with built-in functions only.

Lines become hashes, the hashes are range-partitioned and sorted by document and position, first
occurrences are marked in one pass over that order, and what comes back is one run-length
compressed bitmap per document, not text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.plan import pinned
from pagemill.llm.tables import discard, keyed, store, table

# fixed values: the white space that is stripped, and the letters that are lower-cased
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, _id, _th, pos, first): each line's 128-bit key hash, sorted within ranges of hash and document.

    ``first`` marks the first line of a key in its document.  A key of very many documents spreads
    over as many ranges as it needs, as the document is part of the range key.
    """
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    keys = F.transform(F.split(lower, "\n"), lambda line: F.btrim(line, F.lit(BLANK)))
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    # hashed before they become rows, so that no row holds text; the outer form, as for the inner one the optimizer
    # derives a filter that splits every text a second time
    rows = keyed(docs).select("_id", "_th", F.posexplode_outer(hashes).alias("pos", "h")).where(F.col("h").isNotNull())
    # stored, as finding the bounds of the ranges reads the rows once more
    hashed = store(rows.select("h.h1", "h.h2", "_id", "_th", "pos"), "line-hashes")
    ranges = hashed.repartitionByRange("h1", "h2", "_id", "_th")
    same = Window.partitionBy("h1", "h2", "_id", "_th").orderBy("pos")
    occurrences = store(ranges.withColumn("first", F.row_number().over(same) == 1), "lines")
    discard(hashed)
    return occurrences


def line_bitmaps(docs: DataFrame, min_docs: int = 2, keep: str = "first", min_chars: int = 1) -> DataFrame:
    """One row per document that loses lines: (_id, _th, n_dropped, drop_runs).

    Keys in ``min_docs`` documents or more are repeated.  ``keep="first"`` leaves the first line of
    the first document (smallest id, then text hash); ``keep="none"`` drops all.  ``drop_runs`` is the
    keep bitmap in run-length form: (start, length) of each run of dropped lines, in order.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep must be first or none")
    occurrences = line_occurrences(docs, min_chars)
    firsts = occurrences.where("first").groupBy("h1", "h2")
    measures = [F.count(F.lit(1)).alias("n_docs")]
    if keep == "first":
        measures.append(F.min(F.struct("_id", "_th")).alias("owner"))
    # stored, so that the join below reads both sides as they are and Spark can split a hot key
    repeated = store(firsts.agg(*measures).where(F.col("n_docs") >= min_docs), "repeated-lines")
    dropped = occurrences.join(repeated, ["h1", "h2"])
    if keep == "first":
        dropped = dropped.where(~(F.col("first") & (F.struct("_id", "_th") == F.col("owner"))))
    per_doc = dropped.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    at = F.col("at")
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))
    bitmaps = store(per_doc.select("_id", "_th", F.size(at).cast("bigint").alias("n_dropped"), runs.alias("drop_runs")), "bitmaps")
    discard(occurrences, repeated)
    return bitmaps


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, drop_runs, kept_text) for every row of ``docs``; a null text counts as empty."""
    rows = keyed(docs.select("doc_id", "text")).join(bitmaps, ["_id", "_th"], "left")
    rows = rows.select("doc_id", "n_dropped", "drop_runs", pinned(_lines(F.col("text"))).alias("lines"))
    n, runs = F.size("lines"), F.coalesce("drop_runs", F.array().cast("array<struct<start:int,length:int>>"))
    # stretches that stay: before each dropped run, and after the last
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(n))
    stay = F.zip_with(starts, ends, lambda s, e: F.slice("lines", s + 1, e - s))
    return rows.select(
        "doc_id",
        n.cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        runs.alias("drop_runs"),
        F.array_join(F.flatten(stay), "\n").alias("kept_text"),
    )


def line_dedup(docs: DataFrame, min_docs: int = 2, keep: str = "first", min_chars: int = 1) -> DataFrame:
    """Drop repeated lines; see :func:`line_bitmaps` for the rule and :func:`apply_bitmaps` for the columns.

    Null and empty texts are one empty line, which has no characters and stays.  Null ids are one
    id; rows equal in id and text are one document and lose the same lines.  Other columns of
    ``docs`` are not used.  An empty table gives an empty result.
    """
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, keep, min_chars))


def op9_line_dedup(spark, sf_dir):
    """Lines of keys in ten documents or more are dropped everywhere."""
    result = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, keep="none", min_chars=1)
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines
), repeated AS (
  SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM keys k LEFT JOIN repeated r ON k.key = r.key
GROUP BY k.doc_id
"""
