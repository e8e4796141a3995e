"""Exact quantiles by rank selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.plans.shared import cut


def exact_quantiles(df: DataFrame, column: str, points: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p, n, value): quantiles of the values that are not null, linear between neighbours, as doubles.

    Rank selection: equal values are counted first, their counts are dealt by ranges and added up for each range, and only
    ranges that hold a wanted rank are sorted. No task sees all values. Groups and points without values give no row.
    """
    keys = [F.col(c) for c in by]
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(*keys, "_v").select("*", F.spark_partition_id().alias("_range")), "quantiles")
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))
    along = Window.partitionBy(*by, F.lit(0)).orderBy("_range")  # a row for each range
    sizes = sizes.select("*", (F.sum("_size").over(along) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(*by, F.lit(0))).alias("n"))
    sizes = cut(sizes, "ranges")
    place = F.col("p") * (F.col("n") - 1)
    wanted = sizes.select("*", F.explode(F.array(*map(F.lit, points))).alias("p"))
    wanted = wanted.select(*by, "_range", "_size", "_before", "n", "p", F.inline(F.array(F.struct(F.lit(0).alias("_end"), F.floor(place).alias("_rank")), F.struct(F.lit(1).alias("_end"), F.ceil(place).alias("_rank")))))
    wanted = cut(wanted.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))), "wanted")
    held = ranged.join(wanted.select(*by, "_range", "_before").distinct(), [*by, "_range"])
    inside = Window.partitionBy(*by, "_range").orderBy("_v")
    run = held.select(*by, "_range", "_v", "_n", (F.col("_before") + F.sum("_n").over(inside)).alias("_upto"))
    found = run.join(wanted.drop("_before", "_size"), [*by, "_range"]).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    end = lambda k: F.max(F.when(F.col("_end") == k, F.col("_v").cast("double")))
    both = found.groupBy(*by, "p", "n").agg(end(0).alias("_lo"), end(1).alias("_hi"))
    mixed = (F.ceil(place) - place) * F.col("_lo") + (place - F.floor(place)) * F.col("_hi")
    return both.select(*by, "p", "n", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(mixed).alias("value"))
