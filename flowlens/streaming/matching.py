"""First-in-first-out matching, transit pairs and bursts over a stream: state that watermarks and timers drop, results that are only added.

A day is closed once the watermark has passed its end; rows that come later are dropped, as Structured Streaming does.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.flows import both_ends
from flowlens.plans.shared import shared_dir

#: Spark starts the driver's side of a stateful processor without the session's Python files, so the code travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_MS = 86_400_000
MATCHED = "gid long, day int, matched long, same_day long, incoming long, outgoing long"


def closed_days(rows: DataFrame, late: str) -> DataFrame:
    """(gid, w, in, out): cents of a node's closed days to and from others; a day's sum is state until it is closed."""
    ends = both_ends(rows.where("src <> dst").withWatermark("at", late), "at", "cents")
    on = lambda s: F.sum(F.when(F.col("side") == s, F.col("cents")).otherwise(0)).alias(s)
    return ends.groupBy(F.window("at", "1 day").alias("w"), "gid").agg(on("in"), on("out"))


def match_day(queue: list[tuple[int, int]], day: int, inn: int, out: int, window: int, min_lag: int) -> tuple[list[tuple[int, int]], int, int]:
    """(queue, matched, same_day) after a day, oldest inflow first; the queue has at most window + 1 days."""
    queue = [q for q in queue if q[0] >= day - window] + ([(day, inn)] if inn > 0 else [])
    left, matched, today, kept = out, 0, 0, []
    for d, amount in queue:
        used = min(amount, left) if d <= day - min_lag else 0
        left, matched = left - used, matched + used
        today += used if d == day else 0
        if amount > used:
            kept.append((d, amount - used))
    return kept, matched, today


class FifoQueue(StatefulProcessor):
    """The queue of a node as state; a timer at the end of its newest day's window drops it."""

    window, min_lag = 2, 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "day int, cents long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days = sorted((int(d), int(i), int(o)) for part in rows for d, i, o in part[["day", "came", "sent"]].itertuples(index=False))
        queue = [(int(d), int(c)) for d, c in self.queue.get()] if self.queue.exists() else []
        out = []
        for day, inn, sent in days:
            queue, matched, today = match_day(queue, day, inn, sent, self.window, self.min_lag)
            out.append((key[0], day, matched, today, inn, sent))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if queue:
            self.queue.put(queue)
            # days after this one are closed when the watermark passes their ends: the last that can still use the queue
            self.handle.registerTimer((queue[-1][0] + self.window + 2) * DAY_MS)
        elif self.queue.exists():
            self.queue.clear()
        yield pd.DataFrame(out, columns=["gid", "day", "matched", "same_day", "incoming", "outgoing"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.queue.clear()
        return iter([])

    def close(self) -> None:
        pass


def fifo_days(rows: DataFrame, late: str = "3 days", window: int = 2, min_lag: int = 1) -> DataFrame:
    """(gid, day, matched, same_day, incoming, outgoing) of every closed day, day as a number; summed over days it is the batch's fifo.

    Two stateful steps: sums of days, then each node's queue, which closed days reach in order.
    """
    kept = type("FifoQueue", (FifoQueue,), {"window": window, "min_lag": min_lag})
    days = closed_days(rows, late).select("gid", F.unix_date(F.col("w.start").cast("date")).alias("day"), F.col("in").alias("came"), F.col("out").alias("sent"), F.col("w.end").alias("closed"))
    return days.groupBy("gid").transformWithStateInPandas(kept(), outputStructType=MATCHED, outputMode="append", timeMode="eventTime", eventTimeColumnName="")


def transit_pairs(rows: DataFrame, late: str = "3 days", window: int = 2, percent: int = 85) -> DataFrame:
    """(gid, payer, payee, lag, in_cents, out_cents): money that leaves a node within `window` days of its arrival, to someone else, at
    `percent` agreement or more: an interval join of the stream with itself. Watermarks bound what either side keeps to
    window + late days.
    """
    tx = rows.where("src <> dst")
    inn = tx.withWatermark("at", late).select(F.col("dst").alias("gid"), F.col("src").alias("payer"), F.col("cents").alias("in_cents"), F.col("at").alias("came"))
    out = tx.withWatermark("at", late).select(F.col("src").alias("node"), F.col("dst").alias("payee"), F.col("cents").alias("out_cents"), F.col("at").alias("left"))
    near = (F.col("gid") == F.col("node")) & (F.col("left") >= F.col("came")) & (F.col("left") <= F.col("came") + F.expr(f"interval {window} days"))
    alike = F.least("in_cents", "out_cents") * 100 >= F.greatest("in_cents", "out_cents") * percent
    return inn.join(out, near).where(alike & (F.col("payer") != F.col("payee"))).select("gid", "payer", "payee", F.datediff("left", "came").alias("lag"), "in_cents", "out_cents")


def closed_bursts(rows: DataFrame, late: str = "3 days", least: int = 5) -> DataFrame:
    """(gid, day, side, n): days with `least` transfers or more on one side, each once, when it is closed."""
    ends = both_ends(rows.withWatermark("at", late), "at").where("side = 'out' or not own")
    days = ends.groupBy(F.window("at", "1 day").alias("w"), "gid", "side").agg(F.count("*").alias("n"))
    return days.where(F.col("n") >= least).select("gid", F.col("w.start").cast("date").alias("day"), "side", "n")


#: What transformWithState needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def appended(made: DataFrame, out: str | None = None) -> DataFrame:
    """Run a stream over what has arrived since the last run on the same folder, and return all that it has added there.

    out: the folder of rows and progress; a new one in the shared folder if not given.
    """
    spark = made.sparkSession
    out = out or f"{shared_dir(spark)}/flowlens/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before) if before else spark.conf.unset(STATE_STORE[0])
    return spark.read.schema(made.schema).parquet(f"{out}/rows")
