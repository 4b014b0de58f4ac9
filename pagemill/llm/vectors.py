"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors within a cosine lie within a distance eps.  The vectors are sorted by their grid cells of
side eps on the leading principal axes and cut into a sequence of blocks.  Pairs of intervals of the
sequence are joined recursively: those whose boxes lie more than eps apart are skipped, others are
halved further, down to small tiles whose cosines are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.tables import LAST_ID, id_key, ranked, store, table
from pagemill.llm.tokens import min_labels

# parameters; the sample fixes the axes alone, which change the cost and never the result
SAMPLE = 4_096
AXES = 8
BLOCK = 4_096
TILE = 256
FAN = 8
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal leading axes (one a column) of unit vectors."""
    centred = sample - sample.mean(axis=0)
    return np.linalg.svd(centred, full_matrices=False)[2][:AXES].T


def _celled(axes: np.ndarray, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(_unit(_matrix(batch.column("v"))) @ axes / eps).astype(np.int32)
                cells = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return run


def _packer(axes: np.ndarray, block: int):
    """Arrow step over sorted rows: blocks of consecutive vectors with their boxes on the axes."""

    def packed(part: int, number: int, rows: pa.Table) -> pa.RecordBatch:
        x = _matrix(rows["v"].combine_chunks())
        p = _unit(x) @ axes
        row = {
            "seq": (part << 32) | number, "n_rows": len(x), "h1": rows["h1"].to_pylist(), "h2": rows["h2"].to_pylist(),
            "copies": rows["copies"].to_pylist(), "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(), "x": x.astype(np.float64).tobytes(),
        }
        kind = pa.schema([("seq", pa.int64()), ("n_rows", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("h1", "h2", "copies")],
                          ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("x", pa.binary())])
        return pa.RecordBatch.from_pylist([row], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, number, part = [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            waiting.append(batch)
            n += batch.num_rows
            while n >= block:
                rows = pa.Table.from_batches(waiting)
                yield packed(part, number, rows.slice(0, block))
                rest = rows.slice(block).combine_chunks()
                waiting, n, number = rest.to_batches(), n - block, number + 1
        if n:
            yield packed(part, number, pa.Table.from_batches(waiting))

    return run


PACKED = "seq bigint, n_rows int, h1 array<bigint>, h2 array<bigint>, copies array<bigint>, low array<double>, high array<double>, x binary"


def _near_boxes(a: str, b: str, n_axes: int, eps: float):
    """Whether two boxes (low, high) may hold vectors within eps."""
    gaps = [F.greatest(F.lit(0.0), F.get(f"{a}_low", i) - F.get(f"{b}_high", i), F.get(f"{b}_low", i) - F.get(f"{a}_high", i)) for i in range(n_axes)]
    return reduce(lambda s, g: s + g, [g * g for g in gaps]) <= eps * eps + SLACK


def _box_pairs(boxes: DataFrame, n_blocks: int, n_axes: int, eps: float) -> DataFrame:
    """(a, b), a <= b: blocks that may hold near vectors, from ``boxes`` (block, low, high).

    Goes down a tree of intervals, ``FAN`` at a time; at each level only pairs that are near enough go on.
    """
    levels = 0
    while FAN**levels < n_blocks:
        levels += 1
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a bigint, b bigint")
    child = F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)))
    for level in range(levels - 1, -1, -1):
        ends = [F.min(F.get("low", i)) for i in range(n_axes)] + [F.max(F.get("high", i)) for i in range(n_axes)]
        here = boxes.groupBy(F.floor(F.col("block") / FAN**level).alias("at")).agg(F.array(*ends[:n_axes]).alias("low"), F.array(*ends[n_axes:]).alias("high"))
        below = pairs.withColumn("i", child).withColumn("j", child)
        below = below.select((F.col("a") * FAN + F.col("i")).alias("a"), (F.col("b") * FAN + F.col("j")).alias("b")).where("a <= b")
        for side in ("a", "b"):
            below = below.join(here.select(F.col("at").alias(side), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high")), side)
        pairs = store(below.where(_near_boxes("a", "b", n_axes, eps)).select("a", "b"), "block-pairs")
    return pairs


def _joiner(axes: np.ndarray, cosine: float, eps: float):
    """Arrow step over pairs of blocks: counts of links by vector, and links that connect what is linked."""

    def near(pa_, pb, i, j) -> bool:
        gap = np.maximum(0, np.maximum(pa_[i].min(0) - pb[j].max(0), pb[j].min(0) - pa_[i].max(0)))
        return (gap * gap).sum() <= eps * eps + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, r=r: batch.column(name)[r]
                a, b = get("a").as_py(), get("b").as_py()
                n, m = get("a_rows").as_py(), get("b_rows").as_py()
                x = _unit(np.frombuffer(get("a_x").as_py(), np.float64).reshape(n, -1))
                y = x if a == b else _unit(np.frombuffer(get("b_x").as_py(), np.float64).reshape(m, -1))
                px, py = x @ axes, y @ axes
                cx, cy = np.asarray(get("a_copies").values), np.asarray(get("b_copies").values)
                sx, sy = np.zeros(n, np.int64), np.zeros(m, np.int64)
                shift = 0 if a == b else n
                e, f = [], []

                def join(i0, i1, j0, j1):
                    """Intervals of x and y, halved until they are tiles."""
                    if a == b and j1 <= i0 or not near(px, py, slice(i0, i1), slice(j0, j1)):
                        return
                    if i1 - i0 > TILE or j1 - j0 > TILE:
                        for i in ((i0, (i0 + i1) // 2), ((i0 + i1) // 2, i1)) if i1 - i0 > TILE else ((i0, i1),):
                            for j in ((j0, (j0 + j1) // 2), ((j0 + j1) // 2, j1)) if j1 - j0 > TILE else ((j0, j1),):
                                join(*i, *j)
                        return
                    i, j = np.nonzero(x[i0:i1] @ y[j0:j1].T >= cosine)
                    i, j = i + i0, j + j0
                    if a == b:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        sx[:] += np.bincount(i, weights=cy[j], minlength=n).astype(np.int64)
                        sy[:] += np.bincount(j, weights=cx[i], minlength=m).astype(np.int64)
                        nodes, at = np.unique(np.concatenate([i, j + shift]), return_inverse=True)
                        root = min_labels(len(nodes), at[: len(i)], at[len(i) :])
                        e.append(nodes)
                        f.append(nodes[root])

                join(0, n, 0, m)
                if not e:
                    continue
                node = np.concatenate([(a << 20) + np.arange(n), [] if a == b else (b << 20) + np.arange(m)]).astype(np.int64)
                count = sx + sy if a == b else np.concatenate([sx, sy])
                root = min_labels(len(node), np.concatenate(e), np.concatenate(f))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_pydict({"node": node[some], "count": count[some], "link": node[root[some]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Links join rows whose vectors have at least this cosine, computed in double precision.  n_links counts
    a row's linked rows, component_id is the smallest vec_id reachable, kept tells whether that is the
    row itself.  Vectors that are null, empty, zero, with null or non-finite components, or of another length
    than most, link with nothing.  Equal vectors are compared once and counted as often as they
    occur.  A null id counts as largest and comes back null; such a row is kept if it leads its class.
    An empty table gives an empty result.
    """
    if not 0 < block <= 1 << 20:
        raise ValueError("block must be at most 2**20")
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    spark = vectors.sparkSession
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + 0.0)  # no negative zeros
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", id_key("vec_id").alias("_id"), v.alias("v"))
    lengths = rows.where(sound).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0][0] if lengths else 0
    usable = F.coalesce(sound & (F.size("v") == length), F.lit(False))
    rows = rows.select("vec_id", "_id", usable.alias("usable"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"), "v")
    members = rows.select("vec_id", "_id", "usable", "h1", "h2")
    if not lengths:
        return members.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    distinct = rows.where("usable").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least"), F.first("v").alias("v"))
    distinct = store(distinct, "distinct-vectors")
    sample = distinct.orderBy("h1").limit(SAMPLE).select("v").collect()
    axes = principal_axes(_unit(np.array([r[0] for r in sample])))
    n_axes = axes.shape[1]
    celled = distinct.select("h1", "h2", "copies", "v").mapInArrow(_celled(axes, eps), "h1 bigint, h2 bigint, copies bigint, v array<double>, cells array<int>")
    order = [*[F.get("cells", i) for i in range(n_axes)], F.col("h1")]
    sorted_ = celled.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("cells")
    packed = store(sorted_.mapInArrow(_packer(axes, block), PACKED), "packed")
    blocks = store(ranked(packed, "seq", "block"), "blocks")
    pairs = _box_pairs(blocks.select("block", "low", "high"), blocks.count(), n_axes, eps)
    for side in ("a", "b"):
        pairs = pairs.join(blocks.select(F.col("block").alias(side), *[F.col(c).alias(f"{side}_{t}") for c, t in (("n_rows", "rows"), ("copies", "copies"), ("x", "x"))]), side)
    found = store(pairs.mapInArrow(_joiner(axes, cosine, eps), "node bigint, count bigint, link bigint"), "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("link").alias("b")))
    names = blocks.select("block", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h"))
    names = names.select((F.shiftleft("block", 20) + F.col("i")).alias("node"), "h.h1", "h.h2")
    nodes = names.join(distinct.select("h1", "h2", "copies", "least"), ["h1", "h2"])
    counts = found.groupBy("node").agg(F.sum("count").alias("count"))
    nodes = nodes.join(counts, "node", "left").join(roots, "node", "left")
    nodes = store(nodes.select("h1", "h2", "copies", "least", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("root", "node").alias("root")), "vector-nodes")
    heads = nodes.groupBy("root").agg(F.min("least").alias("head"))
    classes = nodes.join(heads, "root").select("h1", "h2", (F.col("count") + F.col("copies") - 1).alias("n"), "head")
    linked = members.where("usable").join(classes, ["h1", "h2"]).select("vec_id", "_id", "n", "head")
    alone = members.where(~F.col("usable")).select("vec_id", "_id", F.lit(0).cast("bigint").alias("n"), F.col("_id").alias("head"))
    result = linked.unionByName(alone)
    return result.select("vec_id", F.col("n").cast("bigint").alias("n_links"), F.nullif("head", F.lit(LAST_ID)).alias("component_id"), (F.col("_id") == F.col("head")).alias("kept"))


def op6_near_vectors(spark, sf_dir):
    """All embeddings linked at a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), heads AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT h.vec_id, coalesce(n_links, 0) AS n_links, component_id, h.vec_id = component_id AS kept
FROM heads h LEFT JOIN counts USING (vec_id)
"""
