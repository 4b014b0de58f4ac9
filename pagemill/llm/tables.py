"""Stored intermediate tables, document keys and column names shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import scratch_dir

# fixed value: the largest BIGINT stands for a missing id, so that it comes last
LAST_ID = (1 << 63) - 1
BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to Python; texts are long
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/pagemill-llm/{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives lost executors and cuts the lineage.  Shuffle files of the write are
    freed when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`store` that nothing reads any more."""
    for stored in tables:
        _delete(stored.sparkSession, stored.stored_at)


def clear(spark: SparkSession) -> None:
    """Delete all stored tables of this application; results that still read them must be written first."""
    _delete(spark, _folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, on both sides of the Python workers."""
    spark.conf.set(_BATCHES, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(name: str = "doc_id") -> Column:
    """The id with missing ones last and equal to each other."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(LAST_ID))


def text_key(name: str = "text") -> Column:
    """With the id it names a document: rows equal in both are one document."""
    return F.xxhash64(F.col(name))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_id`` and ``_th`` (id and text hash) in front; columns of these names are replaced."""
    rest = others(docs, ["_id", "_th"])
    return docs.select(id_key(id_col).alias("_id"), text_key(text_col).alias("_th"), *rest)


def others(docs: DataFrame, own: Iterable[str]) -> list[Column]:
    """Columns of ``docs`` whose names differ from all of ``own``, whatever their case."""
    taken = {name.lower() for name in own}
    return [docs[f"`{name}`"] for name in docs.columns if name.lower() not in taken]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number the rows of ``df`` from 0 in the order of ``key``, nulls last, without one task seeing all of them.

    ``key`` must be unique.  Only one count for each range partition meets in one place.
    """
    order = F.col(key).asc_nulls_last()
    parts = store(df.repartitionByRange(partitions(df.sparkSession), order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = "sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = counts.select("_part", F.coalesce(F.expr(running), F.lit(0)).alias("_start"))
    within = parts.withColumn("_at", F.expr(f"row_number() OVER (PARTITION BY _part ORDER BY `{key}` ASC NULLS LAST)"))
    return within.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")
