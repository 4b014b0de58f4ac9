"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import store
from pagemill.llm.tokens import min_labels


FOLD = 1 << 20  # links that a task gathers before it reduces them


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = min_labels(len(nodes), at[: len(a)], at[len(a) :])
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a partition by stars, gathering at most FOLD links beside those that stay."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = 0
    for batch in batches:
        a, b = np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()])
        fresh += batch.num_rows
        if fresh > FOLD:
            (a, b), fresh = _stars(a, b), 0
        if len(a) > FOLD:  # too many that stay: hand them on and begin anew
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})
            a, b, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    a, b = _stars(a, b)
    yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour instead."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b) that is not its component's smallest node.

    The number of rounds grows with the logarithm of the number of nodes; each begins with the links that
    lie in one file split, which settles small tables at once.  A node with very many
    links is reduced to a minimum before the shuffle, and its join is split by Spark as skewed.
    Only a count and a checksum of each round reach the driver.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    links = store(links.mapInArrow(_local_stars, "a bigint, b bigint"), "links")
    state = None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen[0] == 0 or seen == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        near = links.mapInArrow(_local_stars, "a bigint, b bigint")
        links = store(_small_star(_large_star(near)), "links")
