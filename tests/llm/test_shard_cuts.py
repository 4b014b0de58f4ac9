"""Shards and slots of tables larger than a test can hold."""

import pytest

from pagemill.llm import sharding


@pytest.mark.parametrize("rows", [7, 2_500_001, 10_000_001, 20_000_000, (1 << 61) + 3])
def test_shard_cuts_are_exact(spark, rows):
    firsts = [-(-s * rows // 8) for s in range(9)]
    ranks = sorted({r for f in firsts for r in (f - 1, f, f + 1) if 0 <= r < rows})
    shard_, slot = sharding.place_of(rows, 8)
    found = spark.createDataFrame([(r,) for r in ranks], "_at bigint").withColumn("shard", shard_).withColumn("slot", slot).collect()
    assert [(r._at, r.shard, r.slot) for r in sorted(found)] == [(r, r * 8 // rows, r - firsts[r * 8 // rows]) for r in ranks]
