"""Merging the fingerprints of more keys than a task holds at once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import fingerprints

KEYS, PARTS = 24_000, 4


@pytest.mark.parametrize("null", [False, True])
def test_no_part_is_lost_when_a_task_flushes(spark, null):
    """One task with 24,000 keys (null may be one), four parts each, of one or two shingles."""
    sketch = {i: fingerprints.spelled(np.array([i + 1, i + 100_000], np.uint64)) for i in range(PARTS)}
    named = F.create_map(*[F.lit(x) for pair in sketch.items() for x in pair])
    rows = spark.range(KEYS * PARTS).select(F.when((F.col("id") % KEYS > 0) | ~F.lit(null), F.col("id") % KEYS + (1 << 53)).alias("key"), named[F.floor(F.col("id") / KEYS).cast("int")].alias("fingerprint"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = fingerprints.merge_fingerprints(rows.coalesce(1), "key").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = fingerprints.spelled(np.array([*range(1, PARTS + 1), *range(100_000, 100_000 + PARTS)], np.uint64))
    assert len(got) == KEYS and {r["key"] for r in got} == {None if null else 1 << 53, *range((1 << 53) + 1, (1 << 53) + KEYS)}
    assert all(r["fingerprint"] == want for r in got)
