"""Bring fetched pages in as a table ``(page_id, url, html)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read ``pages`` from ``parquet``, ``orc`` or ``json`` lines, or from a folder of files (``html``).

    In ``html`` mode every file is one page; its URL is the file's URI and its id a hash of it.
    Rows without content are failed fetches and are left out by the extraction operators.
    """
    if fmt == "html":
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        url = F.col("_metadata.file_path")
        return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))
    reader = spark.read.schema(PAGES_SCHEMA) if fmt == "json" else spark.read
    return reader.format(fmt).load(path).select("page_id", "url", "html")


def spread(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal pages out to ``partitions`` (by default one per core): for a source of few files of one row group each, which Spark
    cannot split.  The documents are shuffled, so it is for the caller to say that this is worth it; a source with as many
    splits stays as it is.
    """
    partitions = partitions or pages.sparkSession.sparkContext.defaultParallelism
    return pages if pages.rdd.getNumPartitions() >= partitions else pages.repartition(partitions, "page_id")


def write_pages_table(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed and sorted by ``page_id``.

    Joins by page with a table bucketed alike (selectors, labels) need no shuffle of the pages then.
    """
    (
        pages.repartition(buckets, "page_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "page_id")
        .sortBy("page_id")
        .saveAsTable(table)
    )
