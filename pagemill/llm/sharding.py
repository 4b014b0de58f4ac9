"""Sharding by a two-pass external shuffle.

First pass: seeded hashes scatter the rows over buckets that fit in memory.  Second pass: a
Fisher-Yates shuffle permutes each bucket, which is then written.  The order of buckets and of rows
in them is a random order of the whole table, cut into shards of equal row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import id_key, others, store, table

# parameters
BUCKET_BYTES = 16 << 20
OWN = ["shard", "slot"]


def _permuter(seed: int):
    """Arrow step over rows sorted by bucket: each bucket in random order, with its position."""

    def shuffled(bucket: int, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(pieces)
        # NumPy's shuffle of an array is the Fisher-Yates algorithm
        order = np.arange(rows.num_rows)
        np.random.default_rng([seed, bucket]).shuffle(order)
        rows = rows.take(pa.array(order))
        at = rows.schema.get_field_index("_at")
        rows = rows.set_column(at, "_at", pa.array(np.arange(rows.num_rows), pa.int64()))
        yield from rows.to_batches(max_chunksize=2_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, pieces = None, []
        for batch in batches:
            ids = batch.column("_bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if ids[a] != bucket and pieces:
                    yield from shuffled(bucket, pieces)
                    pieces = []
                bucket = int(ids[a])
                pieces.append(batch.slice(a, b - a))
        if pieces:
            yield from shuffled(bucket, pieces)

    return run


def text_bytes(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def place_of(rows: int, n_shards: int) -> tuple[F.Column, F.Column]:
    """Shard and slot of the row of rank ``_at`` among ``rows``; the slot reads the column shard.

    Whole numbers throughout (div), as a decimal quotient is rounded; products may pass 2^63.
    """
    wide = f"CAST(CAST(_at AS DECIMAL(38,0)) * {n_shards} AS DECIMAL(38,0))"
    cut = F.expr(f"CAST({wide} div CAST({max(rows, 1)} AS DECIMAL(38,0)) AS INT)")
    first = F.expr(f"(CAST(CAST(shard AS DECIMAL(38,0)) * {rows} AS DECIMAL(38,0)) + {n_shards - 1}) div CAST({n_shards} AS DECIMAL(38,0))")
    return cut, F.col("_at") - first


def shard(docs: DataFrame, n_shards: int, seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0).

    Row counts of shards differ by one at most.  Input columns called shard or slot are replaced.
    Order follows seed, id and text alone; rows equal in both may swap places.  Nulls are values
    like others.  Buckets hold about ``bucket_bytes`` of text each.  Rows that share an id (nulls
    too) and a text would fall into one bucket; where they are more than a bucket's share of rows
    their place in the input spreads them.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(*others(docs, [*OWN, "_bucket", "_at", "_row"]))
    row = F.xxhash64(F.lit(seed), id_key(), F.col("text"))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(text_bytes(F.col("text")) + 64), F.lit(0))).first()
    n_buckets = max(1, -(-size // bucket_bytes))
    share = max(1, rows // n_buckets)
    # fewer than n_buckets rows, as each stands for more than a bucket's share; like the bucket starts
    # below a row is 16 bytes for each bucket_bytes of text, which bounds what is broadcast
    heavy = docs.groupBy(row.alias("_row")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).select("_row", F.lit(True).alias("_heavy"))
    keyed = docs.withColumn("_row", row).join(F.broadcast(heavy), "_row", "left")
    place = F.when(F.col("_heavy"), F.xxhash64("_row", F.monotonically_increasing_id())).otherwise(F.col("_row"))
    keyed = keyed.withColumn("_row", place).drop("_heavy")
    scattered = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(n_buckets))).withColumn("_at", F.lit(0).cast("bigint"))
    buckets = scattered.repartition("_bucket").sortWithinPartitions("_bucket", "_row", id_key())
    written = store(buckets.mapInArrow(_permuter(seed), buckets.schema), "buckets")
    counts = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = "sum(_n) OVER (ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = counts.select("_bucket", F.coalesce(F.expr(running), F.lit(0)).alias("_start"))
    placed = written.join(F.broadcast(starts), "_bucket").withColumn("_at", F.col("_start") + F.col("_at"))
    shard_, slot = place_of(rows, n_shards)
    placed = placed.withColumn("shard", shard_).withColumn("slot", slot)
    return placed.drop("_bucket", "_at", "_row", "_start")


def op1_shard(spark, sf_dir):
    """All documents in eight shards whose row counts differ by one at most."""
    placed = shard(table(spark, sf_dir, "documents"), 8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        (text_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
