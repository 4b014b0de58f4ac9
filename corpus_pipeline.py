"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, mixing, quality, sharding, simhash
from pagemill.llm.tables import others, store, table

# parameters
SHARDS = 8
DISTANCE, WIDTH = 4, 4  # bits of SimHashes of word shingles, as in op3


INPUT = ("doc_id", "text", "lang", "source")  # columns of a document that stages read


def with_user_columns(docs: DataFrame, step: Callable[[DataFrame], DataFrame], added: tuple[str, ...] = ()) -> DataFrame:
    """``step`` of the documents, all columns kept as they are, and the ``added`` ones, which replace columns of their names.

    Columns that no stage reads travel in one struct, so none of them can clash with a name of a stage's own.
    """
    read = [c for c in docs.columns if c.lower() in INPUT]
    rest = [c for c in docs.columns if c.lower() not in INPUT]
    packed = docs.select(*read, F.struct(*[docs[f"`{c}`"] for c in rest]).alias("user_columns")) if rest else docs
    done = step(packed)
    own = [F.col(f"`{c}`") if c in read else F.col(f"user_columns.`{c}`").alias(c) for c in docs.columns if c.lower() not in added]
    return done.select(*own, *added)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return with_user_columns(docs, lambda d: quality.accepted(d, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each class of near SimHashes."""
    return with_user_columns(docs, lambda d: simhash.without_near_duplicates(d, DISTANCE, WIDTH))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return with_user_columns(docs, lambda d: decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or more."""
    def taken(d: DataFrame) -> DataFrame:
        mixed = mixing.mix(d.withColumn("size", mixing.word_count(F.col("text"))))
        return mixed.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))))

    return with_user_columns(docs, taken)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order over shards of equal row counts."""
    return with_user_columns(docs, lambda d: sharding.shard(d, SHARDS), added=("shard", "slot"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

# The classifier and the random draws cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
