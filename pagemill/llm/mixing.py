"""Mixing sources to target weights by pivotal rounding.

Every document starts with a fractional number of copies, its source's target over its source's
size.  Within a chunk of a source, fractional documents meet in pairs: words move from one to the
other at random, without bias and without changing their sum, until one of the two numbers is whole.
Each chunk leaves one fractional document at most; these meet in the next level of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import id_key, others, ranked, store, table

# parameters
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
CHUNK_ROWS = 50_000
FAN = 1_000

OWN = ["size", "source_size", "target", "copies"]
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, nulls last, take ``weights`` in turn.  Targets share ``share`` of all
    sizes by weight; none exceeds ``cap`` times its source's size, what is above goes to the others
    by weight again.  The driver sees two sums a round; a round settles all sources above their cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    at = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), at)
    totals = store(ranked(totals, "source", "_rank").select("source", "source_size", weight.alias("weight")), "sources")
    whole = share * float(totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    limit, level = cap * F.col("source_size"), 0.0
    while True:
        capped = F.col("weight") * F.lit(level) > limit
        settled, free = totals.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        if free == 0 or (raised := (whole - settled) / free) <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), limit)
    return totals.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) fixed by two row hashes."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def meet(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Move words between two documents of sizes ``s``, ``t`` with fractions ``p``, ``q`` in (0, 1).

    p*s + q*t stays, the expected value of either stays, and one becomes 0 or 1; ``u`` is uniform.
    """
    up, q_left = (1 - p, q - (1 - p) * s / t) if (1 - p) * s <= q * t else (q * t / s, 0.0)
    down, q_more = (p, q + p * s / t) if p * s <= (1 - q) * t else ((1 - q) * t / s, 1.0)
    if u * (up + down) < down:
        return (1.0 if q_left > 0 else p + up), q_left
    return (0.0 if q_more < 1 else p - down), q_more


def _rounder(last: bool):
    """Arrow step over rows sorted by (source, _chunk): sets ``copies``, and ``_p`` null for settled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, held_row = None, None, None  # the fractional document that waits for another

        def settled(row: pa.Table, fraction: float | None, copies: int) -> pa.Table:
            row = row.set_column(row.schema.get_field_index("copies"), "copies", pa.array([copies], pa.int64()))
            return row.set_column(row.schema.get_field_index("_p"), "_p", pa.array([fraction], pa.float64()))

        def leave() -> pa.Table:
            """The group's last fractional document: decided at the root, else passed on."""
            p, _, r, copies = held
            if last:
                return settled(held_row, None, copies + (_uniform(r, 0) < p))
            return settled(held_row, p, copies)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            n = rows.num_rows
            groups = list(zip(rows["source"].to_pylist(), rows["_chunk"].to_pylist(), strict=True))
            fractions = rows["_p"].to_numpy(zero_copy_only=False).astype(float).copy()
            copies = rows["copies"].to_numpy().copy()
            sizes, hashes = rows["size"].to_pylist(), [h & 0xFFFFFFFFFFFFFFFF for h in rows["_r"].to_pylist()]
            out, at = [], -1  # at: the held row's place in this batch, -1 if it came with an earlier one
            if held is not None:
                at = -1
            for i in range(n):
                if groups[i] != group:
                    if held is not None:
                        if at < 0:
                            out.append(leave())
                        elif last:
                            copies[at] += _uniform(held[2], 0) < held[0]
                            fractions[at] = np.nan
                        else:
                            fractions[at] = held[0]
                        held = None
                    group = groups[i]
                p = fractions[i]
                if p != p:  # settled before
                    continue
                if p <= 0 or p >= 1 or sizes[i] <= 0:
                    copies[i] += int(p >= 1) if not 0 < p < 1 else int(_uniform(hashes[i], 0) < p)
                    fractions[i] = np.nan
                    continue
                if held is None:
                    held, at = (p, sizes[i], hashes[i], int(copies[i])), i
                    continue
                a, b = meet(held[0], held[1], p, sizes[i], _uniform(held[2], hashes[i]))
                if a <= 0 or a >= 1:  # the held one is whole; this one waits on, unless it is whole as well
                    if at < 0:
                        out.append(settled(held_row, None, held[3] + int(a >= 1)))
                    else:
                        copies[at] += int(a >= 1)
                        fractions[at] = np.nan
                    held = None
                    if 0 < b < 1:
                        held, at = (b, sizes[i], hashes[i], int(copies[i])), i
                    else:
                        copies[i] += int(b >= 1)
                        fractions[i] = np.nan
                else:
                    copies[i] += int(b >= 1)
                    fractions[i] = np.nan
                    held = (a, *held[1:])
            stay = np.ones(n, bool)
            if held is not None and at >= 0:
                held_row, stay[at] = rows.slice(at, 1), False
            rows = rows.set_column(rows.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
            rows = rows.set_column(rows.schema.get_field_index("_p"), "_p", pa.array(fractions, pa.float64(), from_pandas=True))
            for piece in [rows.filter(pa.array(stay)), *out]:
                yield from piece.to_batches()
            at = -1
        if held is not None:
            yield from leave().to_batches()

    return run


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 5, chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Copies of each row of ``docs`` (doc_id, source, size, anything else) that bring sources to their targets.

    Adds source_size, target and copies (0 or more); columns of these names are replaced.  A null
    source is a source; a null or negative size is 0.  Rows without words get whole copies by chance alone,
    as they move no words.  Each source's copied words differ from its target by less than one
    document.  Draws depend on seed, id and size, so reruns agree; rows equal in id, size and source may
    swap their copies.  An empty table gives an empty result.
    """
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    docs = docs.select(*others(docs, [*OWN, "_r", "_chunk", "_p"]), size.alias("size"))
    targets = source_targets(docs, weights, share, cap)
    n_chunks = max(1, -(-docs.count() // chunk_rows))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target", ratio.alias("_ratio"))
    rows = docs.join(targets, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = rows.withColumn("_r", F.xxhash64(F.lit(seed), id_key(), F.col("size")))
    rows = rows.withColumn("copies", F.floor("_ratio").cast("bigint")).withColumn("_p", F.col("_ratio") - F.floor("_ratio"))
    rows = rows.withColumn("_chunk", F.pmod("_r", F.lit(n_chunks))).drop("_ratio")
    done, level = None, 0
    while True:
        dealt = rows.repartition("source", "_chunk").sortWithinPartitions("source", "_chunk", "_r", id_key())
        level, last = level + 1, n_chunks == 1
        rows = store(dealt.mapInArrow(_rounder(last), dealt.schema), f"mix-{level}")
        settled = rows.where(F.col("_p").isNull())
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done.drop("_r", "_chunk", "_p")
        n_chunks = -(-n_chunks // fan)
        rows = rows.where(F.col("_p").isNotNull()).withColumn("_chunk", F.pmod("_chunk", F.lit(n_chunks)))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def op5_mix_sources(spark, sf_dir):
    """All documents mixed to 150 % of their words, sources weighing 3, 1, 2 in turn."""
    docs = table(spark, sf_dir, "documents")
    sized = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed = mix(sized)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")
