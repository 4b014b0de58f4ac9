"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits share a partition of the 64.  Each partition gets its own threshold; the thresholds
sum to (distance - partitions + 1), so that two fingerprints within the distance are within the
threshold of at least one partition.  Dynamic programming picks the thresholds, and the number of
partitions, with the fewest estimated candidates.  Within a partition, keys with as many bits masked
as its threshold bring candidates together; they are verified there by the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagemill.llm.components import components
from pagemill.llm.tables import LAST_ID, keyed, others, partitions, store, table
from pagemill.llm.tokens import min_labels

# parameters; the sample serves the plan alone, which changes the cost and never the result
BITS = 64
SAMPLE = 2_048
BLOCK = 4_096
PROBE_COST = 40.0  # a shuffled probe row, in verified pairs


def fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()  # of bytes: A-Z alone, and white space of ASCII alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, _id, _th, fp): the 64-bit SimHash of each row's word shingles; 0 without words."""

    @F.arrow_udf(LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or b"", width) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return keyed(docs.select("doc_id", "text")).select("doc_id", "_id", "_th", simhash("text").alias("fp"))


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, each grown from the bit pairs that agree most in the sample."""
    x = bits - bits.mean(axis=0)
    spread = np.sqrt((x * x).sum(axis=0)) + 1e-9
    tie = np.abs((x.T @ x) / np.outer(spread, spread))
    left, out = list(range(BITS)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        among = tie[np.ix_(left, left)] - np.eye(len(left))
        group = [left[int(among.sum(axis=1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: tie[b, group].sum()))
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def plan_probes(sample: np.ndarray, n: int, distance: int) -> list[int]:
    """Masks to probe ``n`` distinct fingerprints with, the cheapest by the pairs of ``sample``."""
    best, chosen = None, None
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    for m in range(1, distance + 2):
        total, groups = distance - m + 1, _groups(bits, m)
        costs = []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            keys = sample & mask
            apart = np.bitwise_count(keys[:, None] ^ keys[None, :])
            # half a pair is added, as an empty count in a sample is no proof of none
            near = [0.0, *[((apart <= e).sum() - len(sample)) / 2 + 0.5 for e in range(total + 1)]]
            scale = (n / max(len(sample), 1)) ** 2
            costs.append([comb(len(group), e) * n * PROBE_COST + near[e + 1] * scale if e >= 0 else 0.0 for e in range(-1, total + 1)])
        # table[s]: least cost of thresholds that sum to s; a threshold of -1 leaves a partition out
        reach = {0: (0.0, ())}
        for cost in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, t) in reach.items():
                for e, extra in enumerate(cost, -1):
                    if s + e not in step or c + extra < step[s + e][0]:
                        step[s + e] = (c + extra, (*t, e))
            reach = step
        if total in reach and (best is None or reach[total][0] < best):
            best, chosen = reach[total][0], (groups, reach[total][1])
    masks = []
    for group, threshold in zip(*chosen, strict=True):
        for cleared in combinations(group, threshold) if threshold >= 0 else ():
            masks.append(sum(1 << b for b in group if b not in cleared))
    return masks


def _near_links(distance: int):
    """Arrow step over rows sorted by block: verified links, as few as connect what they connect."""

    def links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for i in range(0, len(fps), 1_024):
            for j in range(i, len(fps), 1_024):
                x, y = np.nonzero(np.bitwise_count(fps[i : i + 1_024, None] ^ fps[None, j : j + 1_024]) <= distance)
                later = x + i < y + j
                if later.any():  # a spanning forest of the tile stands for its pairs
                    x, y = x[later] + i, y[later] + j
                    root = min_labels(len(fps), x, y)
                    a.append(np.flatnonzero(root != np.arange(len(fps))))
                    b.append(root[a[-1]])
        if not a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        root = min_labels(len(fps), np.concatenate(a), np.concatenate(b))
        away = np.flatnonzero(root != np.arange(len(fps)))
        return away, root[away]

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """All blocks of ``rows``, each whole."""
        fps = rows["fp"].to_numpy().view(np.uint64)
        block = np.zeros(len(fps), bool)
        block[0] = True
        for name in ("probe", "key", "t1", "t2"):
            c = rows[name].to_numpy()
            block[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(block)
        sizes = np.diff(np.append(starts, len(fps)))
        number = np.repeat(np.arange(len(starts)), sizes)
        out_a, out_b = [], []
        # small blocks together: rows k apart that share a block
        small = np.repeat(sizes <= 64, sizes)
        sf, sn = fps[small], number[small]
        for k in range(1, int(min(64, sizes[sizes <= 64].max(initial=1)))):
            same = np.flatnonzero(sn[k:] == sn[:-k])
            if not len(same):
                break
            near = same[np.bitwise_count(sf[same] ^ sf[same + k]) <= distance]
            out_a.append(sf[near])
            out_b.append(sf[near + k])
        for at, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            x, y = links(fps[at : at + size])
            out_a.append(fps[at + x])
            out_b.append(fps[at + y])
        if out_a and sum(map(len, out_a)):
            a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = min_labels(len(nodes), at[: len(a)], at[len(a) :])
            away = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_pydict({"a": nodes[away], "b": nodes[root[away]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append(batch)
            last = [batch.column(name)[-1].as_py() for name in ("probe", "key", "t1", "t2")]
            rows = pa.Table.from_batches(waiting)
            tail = np.ones(rows.num_rows, bool)
            for name, value in zip(("probe", "key", "t1", "t2"), last, strict=True):
                tail &= rows[name].to_numpy() == value
            cut = int(rows.num_rows - tail[::-1].argmin()) if not tail.all() else 0
            if cut:
                yield from whole(rows.slice(0, cut))
                waiting = rows.slice(cut).combine_chunks().to_batches()
        if waiting:
            yield from whole(pa.Table.from_batches(waiting))

    return run


def near_fingerprints(distinct: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp) that connect all within ``distance`` bits, and no others.

    A block of more than ``block`` fingerprints is dealt out as pairs of chunks, so that no task holds
    it and no pair is lost.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()]
    masks = plan_probes(np.array(sample, np.int64).view(np.uint64), n, distance)
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    probes = F.array(*[F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(probes).alias("p")).select("p.probe", "p.key", "fp")
    sizes = rows.groupBy("probe", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(2 * F.col("n") / F.lit(block)).cast("int")
    rows = rows.join(sizes, ["probe", "key"])
    chunk = F.pmod(F.xxhash64("fp"), chunks.cast("bigint")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(chunk, c).alias("t1"), F.greatest(chunk, c).alias("t2")))
    alone = F.array(F.struct(F.lit(0).alias("t1"), F.lit(0).alias("t2")))
    tiles = rows.withColumn("tile", F.explode(F.when(F.col("n") > block, pairs).otherwise(alone)))
    tiles = tiles.select("probe", "key", "tile.t1", "tile.t2", "fp")
    dealt = tiles.repartition(partitions(spark), "probe", "key", "t1", "t2").sortWithinPartitions("probe", "key", "t1", "t2")
    return dealt.mapInArrow(_near_links(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, distance: int, width: int) -> DataFrame:
    """(doc_id, _id, _th, fp, component_id, owner) for each row of ``docs``: classes of near fingerprints.

    ``component_id`` is the smallest doc_id that links lead to, ``owner`` the smallest (id, text hash).
    Null and empty texts, and texts of white space, have fingerprint 0 and are near each other;
    texts of fewer words than ``width`` are one shingle.  A null id counts as largest; a class of
    null ids alone has a null component.  Repeated rows each give a row.  Other columns are not
    used.  An empty table gives no rows.
    """
    marked = store(fingerprints(docs, width), "fingerprints")
    distinct = store(marked.groupBy("fp").agg(F.min(F.struct("_id", "_th")).alias("least")), "distinct")
    roots = components(near_fingerprints(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = store(rooted, "roots")
    owners = rooted.groupBy("root").agg(F.min("least").alias("owner"))
    classes = rooted.join(owners, "root").select("fp", F.nullif("owner._id", F.lit(LAST_ID)).alias("component_id"), "owner")
    return marked.join(classes, "fp").select("doc_id", "_id", "_th", "fp", "component_id", "owner")


def without_near_duplicates(docs: DataFrame, distance: int, width: int) -> DataFrame:
    """The rows of ``docs`` that are first in their class of :func:`near_duplicates`; all columns but ``_id`` and ``_th`` stay.

    First is the smallest id (null last), then text hash.  Of equal rows (id, null too, and text) one stays.
    """
    owners = near_duplicates(docs, distance, width).select("owner.*").distinct()
    kept = keyed(docs).join(store(owners, "owners"), ["_id", "_th"], "left_semi")
    twins = keyed(docs.select("doc_id", "text")).groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twins.isEmpty():
        kept = kept.dropDuplicates(["_id", "_th"])  # combines before the shuffle
    return kept.select(*others(kept, ["_id", "_th"]))


def op3_simhash(spark, sf_dir):
    """Classes of documents whose SimHashes of 4-word shingles lie within 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
