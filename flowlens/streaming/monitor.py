"""Pair totals, repeated amounts and busy days over a stream of transactions (an extension: the batch operators, kept up to date)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.flows import both_ends
from flowlens.plans.shared import shared_dir

COLUMNS = "src long, dst long, date date, sum_kzt double"


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that arrive at path: (src, dst, day, cents, at)."""
    rows = spark.readStream.schema(COLUMNS).parquet(path)
    return rows.select("src", "dst", F.col("date").alias("day"), F.rint(F.col("sum_kzt") * 100).cast("long").alias("cents"), F.col("date").cast("timestamp").alias("at"))


def burst_counts(rows: DataFrame, late: str = "3 days", least: int = 5) -> DataFrame:
    """(gid, day, side, n): as bursts of a batch. State older than `late` before the newest day is dropped."""
    ends = both_ends(rows.withWatermark("at", late), "day", "at").where("side = 'out' or not own")
    days = ends.groupBy(F.window("at", "1 day").alias("w"), "gid", "side").agg(F.count("*").alias("n"), F.min("day").alias("day"))
    return days.where(F.col("n") >= least).select("gid", "day", "side", "n")


def repeat_counts(rows: DataFrame, least: int = 3) -> DataFrame:
    """(src, dst, cents, n): as repeated_amounts of a batch; one count of state for each pair and amount."""
    return rows.where("src <> dst").groupBy("src", "dst", "cents").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def drain(counts: DataFrame) -> DataFrame:
    """Run a streaming aggregation over what has arrived, and return its complete state, written to the shared folder."""
    spark = counts.sparkSession
    out = f"{shared_dir(spark)}/flowlens/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/state")
