"""Streams against the batch operators: late and out-of-order days, state that is dropped, results that are added once."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.operators import fifo
from flowlens.sources.tables import as_network
from flowlens.streaming import matching

DAY = dt.date(2026, 7, 1)
SCHEMA = "src long, dst long, date date, sum_kzt double"


def moves(seed: int, days: range, n: int):
    r = random.Random(seed)
    return [(r.randrange(5), r.randrange(5), DAY + dt.timedelta(r.choice(days)), 10.0 * r.randrange(1, 9)) for _ in range(n)]


class Arrivals:
    """A folder in which files arrive, and a stream run on it after each."""

    def __init__(self, spark, tmp_path, build):
        self.spark, self.folder, self.out, self.build, self.k = spark, tmp_path / "in", str(tmp_path / "out"), build, 0

    def arrive(self, rows):
        self.k += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.folder / f"part={self.k}"))
        source = self.spark.readStream.schema(SCHEMA + ", part int").parquet(str(self.folder))
        stream = source.select("src", "dst", F.col("date").alias("day"), F.rint(F.col("sum_kzt") * 100).cast("long").alias("cents"), F.col("date").cast("timestamp").alias("at"))
        return matching.appended(self.build(stream), self.out)


def batch_fifo(spark, rows, upto, min_lag=1):
    """{gid: (matched, total_in, total_out)} of the batch's fifo over rows up to a day."""
    kept = [x for x in rows if x[2] <= upto]
    t = spark.createDataFrame(kept, SCHEMA)
    nodes = spark.range(5).select(F.col("id").alias("gid"), F.lit(1).alias("depth"), F.lit(False).alias("is_seed"))
    net = as_network(nodes, t.groupBy("src", "dst").agg(F.sum("sum_kzt").alias("sum_kzt"), F.count("*").alias("n_tx"), F.lit(1).alias("depth")), t)
    return {r["gid"]: (r["matched"], r["same_day"], r["total_in"], r["total_out"]) for r in fifo.fifo(net, 2, min_lag).collect()}


def summed(found):
    return {r["gid"]: tuple(r)[1:] for r in found.groupBy("gid").agg(F.sum("matched"), F.sum("same_day"), F.sum("incoming"), F.sum("outgoing")).collect()}


@pytest.mark.parametrize("min_lag", [0, 1])
def test_fifo_days_are_the_batch(spark, tmp_path, min_lag):
    """Days arrive out of order within the watermark's delay; closed days match as in the batch; a row that is too late is dropped."""
    runs = Arrivals(spark, tmp_path, lambda s: matching.fifo_days(s, min_lag=min_lag))
    first, second = moves(1, range(0, 8), 80), moves(2, range(6, 14), 80)  # days 6 and 7 still come in the second run
    runs.arrive(first)
    found = runs.arrive(second)
    newest = max(x[2] for x in first + second if x[0] != x[1])
    upto = newest - dt.timedelta(4)
    assert summed(found) == batch_fifo(spark, first + second, upto, min_lag)
    late = [(0, 1, DAY, 990.0), (1, 2, DAY + dt.timedelta(1), 990.0)]
    found = runs.arrive(late + moves(3, range(14, 22), 60))
    assert not [r for r in found.collect() if r["incoming"] == 99_000 or r["outgoing"] == 99_000]
    assert found.groupBy("gid", "day").count().where("count > 1").isEmpty()  # each day once


def test_a_queue_is_the_fold():
    r = random.Random(5)
    for _ in range(200):
        window, lag = r.randrange(0, 4), r.randrange(0, 3)
        days = sorted((d, r.choice([0, 0, 5, 9, 20]), r.choice([0, 0, 4, 11, 30])) for d in r.sample(range(12), 6))
        queue, total = [], 0
        plain, want = [], 0
        for day, inn, out in days:
            queue, matched, _ = matching.match_day(queue, day, inn, out, window, lag)
            total += matched
            assert len(queue) <= window + 1
            plain.append([day, inn])
            left = out
            for entry in plain:
                if day - window <= entry[0] <= day - lag:
                    used = min(entry[1], left)
                    entry[1] -= used
                    left -= used
                    want += used
        assert total == want


def test_state_is_dropped(spark, tmp_path):
    """After a long silence the queues of the days before are gone from the store."""
    runs = Arrivals(spark, tmp_path, matching.fifo_days)
    held = []
    spark.conf.set(*matching.STATE_STORE)
    try:
        for rows in (moves(1, range(0, 12), 90), [(0, 1, DAY + dt.timedelta(60), 10.0)], [(0, 1, DAY + dt.timedelta(120), 10.0)], [(0, 1, DAY + dt.timedelta(180), 10.0)]):
            runs.arrive(rows)
            held.append(spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "queue").load(f"{runs.out}/progress").count())
    finally:
        spark.conf.unset(matching.STATE_STORE[0])
    assert held[0] > 2 and held[-1] <= 2


def test_transit_pairs_meet_within_the_window(spark, tmp_path):
    runs = Arrivals(spark, tmp_path, matching.transit_pairs)
    first, second = moves(6, range(0, 6), 70), moves(7, range(4, 10), 70)
    runs.arrive(first)
    found = Counter(tuple(r) for r in runs.arrive(second).collect())
    rows = [(a, b, d, round(100 * x)) for a, b, d, x in first + second if a != b]
    want = Counter((b, a, q[1], (q[2] - d).days, x, q[3]) for a, b, d, x in rows for q in rows if q[0] == b and 0 <= (q[2] - d).days <= 2 and q[1] != a and min(x, q[3]) * 100 >= max(x, q[3]) * 85)
    assert found == want


def test_bursts_come_once_and_late_rows_do_not_count(spark, tmp_path):
    runs = Arrivals(spark, tmp_path, lambda s: matching.closed_bursts(s, least=3))
    runs.arrive([(1, 2, DAY, 10.0)] * 3 + [(3, 4, DAY + dt.timedelta(5), 10.0)] * 2)
    assert runs.arrive([(3, 4, DAY + dt.timedelta(5), 10.0), (9, 9, DAY + dt.timedelta(6), 10.0)]).count() == 2  # of day 0, both ends
    got = runs.arrive([(1, 2, DAY, 10.0)] * 5 + [(8, 7, DAY + dt.timedelta(20), 10.0)])
    assert {(r["gid"], r["day"], r["side"], r["n"]) for r in got.collect()} == {(1, DAY, "out", 3), (2, DAY, "in", 3), (3, DAY + dt.timedelta(5), "out", 3), (4, DAY + dt.timedelta(5), "in", 3)}
