"""Rank statistics and agreement measures as windows and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.flows import six
from flowlens.plans.shared import cut, sums_before


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank of value (ties share their mean place).

    Values are counted first, so the running sum is over distinct values, not rows.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranks = sums_before(counts, [value], _before=F.col("_n")).select(F.col(value).alias("_v"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def rank_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank of value over the number of rows; 0 where value is not above 0."""
    total = df.agg(F.count("*").alias("_all"))
    ranked = average_ranks(df, value, "_r").crossJoin(F.broadcast(total))
    return ranked.withColumn(name, F.when(F.col(value) > 0, F.col("_r") / F.col("_all")).otherwise(0.0)).drop("_r", "_all")


def rank_shares(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """df with, for each name and column of `values`, the rank_share of the column: all columns are ranked in one order of
    (column, value), in which each takes as many places as there are rows."""
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(values.values())]))
    counts = df.select(listed.alias("x")).groupBy("x.m", "x.v").agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("rows")))  # one row
    place = F.col("before") - F.col("m") * F.col("rows") + (F.col("n") + 1) / 2
    ranked = sums_before(counts, ["m", "v"], before=F.col("n")).crossJoin(total).select("m", "v", F.when(F.col("v") > 0, place / F.col("rows")).otherwise(0.0).alias("share"))
    ranked = cut(ranked, "shares")
    for i, (name, c) in enumerate(values.items()):
        one = ranked.where(F.col("m") == i).select(F.col("v").alias("_v"), F.col("share").alias(name))
        df = df.join(one, F.col(c).cast("double") == F.col("_v"), "left").drop("_v")
    return df


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: the chance that a true row scores above a false one, ties as half."""
    r = average_ranks(df, score, "r").agg(F.sum(F.when(F.col(truth), F.col("r"))).alias("s"), F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))
    return r.select("pos", "n", six((F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("auc"))


def ks_distance(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: the largest distance between the empirical distributions of value in the two groups of a boolean."""
    per = df.groupBy(value).agg(F.sum(F.col(group).cast("long")).alias("a"), F.sum((~F.col(group)).cast("long")).alias("b"))
    run = sums_before(per, [value], before_a=F.col("a"), before_b=F.col("b"))
    total = F.broadcast(per.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b")))  # one row
    gap = F.abs((F.col("before_a") + F.col("a")) / F.col("all_a") - (F.col("before_b") + F.col("b")) / F.col("all_b"))
    return run.crossJoin(total).select(gap.alias("gap")).agg(six(F.max("gap")).alias("ks"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings of the same rows."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).count()
    both = cells.agg(F.sum(pairs(F.col("count"))).alias("both"))
    of_a = cells.groupBy(a).agg(F.sum("count").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("of_a"))
    of_b = cells.groupBy(b).agg(F.sum("count").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("of_b"))
    n = df.agg(pairs(F.count("*")).alias("all"))
    row = both.crossJoin(of_a).crossJoin(of_b).crossJoin(n)
    chance = F.col("of_a") * F.col("of_b") / F.col("all")
    return row.select(F.when((F.col("of_a") + F.col("of_b")) / 2 == chance, F.lit(1.0)).otherwise(six((F.col("both") - chance) / ((F.col("of_a") + F.col("of_b")) / 2 - chance))).alias("rand"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of average ranks."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, "ra"), b, "rb")
    return ranked.agg(six(F.corr("ra", "rb")).alias("rho"))


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """One row: keys shared by the k highest of either column (ties: smallest key), and their Jaccard similarity."""
    first = lambda c: df.orderBy(F.desc(c), key).limit(k).select(key)
    both = first(a).intersect(first(b)).agg(F.count("*").alias("shared"))
    any_ = first(a).union(first(b)).distinct().agg(F.count("*").alias("either"))
    return both.crossJoin(any_).withColumn("jaccard", six(F.col("shared") / F.col("either")))


def top_changes(df: DataFrame, key: str, score: str, before: str, after: str, k: int) -> DataFrame:
    """One row: of the k highest by score (ties: smallest key), those whose label differs between two columns."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.agg(F.count("*").alias("n"), F.sum((F.col(before) != F.col(after)).cast("long")).alias("changed"))


def transitions(df: DataFrame, a: str, b: str) -> DataFrame:
    """(before, after, n): how often each pair of labels stands in the two columns."""
    return df.groupBy(F.col(a).alias("before"), F.col(b).alias("after")).agg(F.count("*").alias("n"))



def top_matrix(df: DataFrame, key: str, metrics: tuple[str, ...], k: int) -> DataFrame:
    """(a, b, shared): for each two metrics, the keys among the k highest of both (ties: smallest key)."""
    long = df.unpivot([key], list(metrics), "metric", "value")
    top = long.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), key))).where(F.col("r") <= k)
    a, b = (top.select(key, F.col("metric").alias(m)) for m in ("a", "b"))
    return a.join(b, key).groupBy("a", "b").agg(F.count("*").alias("shared"))


def metric_error(exact: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the largest absolute error of a metric, and zeros where the exact value is above 0."""
    both = exact.join(other.select(key, F.col(value).alias("_other")), key)
    return both.agg(F.max(F.abs(F.col(value) - F.col("_other"))).alias("max_error"), F.sum(((F.col(value) > 0) & (F.col("_other") == 0)).cast("long")).alias("false_zeros"))
