"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import discard, materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table (rows, and bytes as text); reading stops just past the row bound."""
    head = small.limit(max_rows + 1)
    width = F.length(F.to_json(F.struct(*small.columns)))
    rows, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def hot_keys(big: DataFrame, key: str) -> DataFrame:
    """``(key, _shares)``: the keys that hold more than a task's share of ``big``, with the number of their shares.

    There are fewer of them than shuffle partitions.
    """
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    shares = F.ceil(F.col("_n") * partitions / F.lit(max(total, 1))).cast("int")
    hot = materialize(counts.where((F.col("_n") * partitions > total) & F.col(key).isNotNull()).select(key, shares.alias("_shares")), "hot-keys")
    discard(counts)
    return hot


def skew_safe_join(
    big: DataFrame, small: DataFrame, key: str, how: str = "inner", broadcast: bool | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Join ``big`` (any number of rows per key) with ``small`` (one row per key); ``how``: inner or left.

    A ``small`` of measured size is broadcast.  Otherwise keys that hold more than a task's share
    of ``big`` are salted: their rows, equal ones too, are dealt in turn over as many tasks as the key has
    shares, and their ``small`` row is copied to each.  There are fewer such keys than shuffle
    partitions, so their list is broadcast safely; ``hot`` hands on the list of an earlier join of the same table.
    ``big`` should come from a scan or a stored table, whose rows keep their order when a task runs again.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if broadcast is None:
        broadcast = fits_broadcast(small)
    if broadcast:
        return big.join(F.broadcast(small), key, how)
    if hot is None:
        hot = hot_keys(big, key)
    turn = F.pmod(F.monotonically_increasing_id(), F.col("_shares").cast("bigint")).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)
    left = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(turn, F.lit(0))).drop("_shares")
    right = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_shares")
    return left.join(right, [key, "_salt"], how).drop("_salt")
