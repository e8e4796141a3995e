"""Degrees, flows and profiles of nodes, and plain statistics of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.quantiles import exact_quantiles
from flowlens.plans.shared import cut, sums_before
from flowlens.sources.tables import Network


def nine(x: Column) -> Column:
    """Rounded half-even to nine digits: sums that differ in their order only come out equal."""
    return F.rint(x * 1e9) / 1e9


def six(x: Column) -> Column:
    """Rounded half-even to six digits."""
    return F.rint(x * 1e6) / 1e6


def both_ends(df: DataFrame, *cols: str) -> DataFrame:
    """Each row once for its sender (side 'out') and once for its receiver ('in'), keyed by gid."""
    ends = F.array(F.struct(F.col("src").alias("gid"), F.lit("out").alias("side")), F.struct(F.col("dst").alias("gid"), F.lit("in").alias("side")))
    return df.select(F.explode(ends).alias("e"), (F.col("src") == F.col("dst")).alias("own"), *cols).select("e.*", "own", *cols)


def turnover(net: Network) -> DataFrame:
    """(gid, in_deg, out_deg, in/out cents with and without self-transfers, in/out counts, pass_through) of every node: one
    aggregation of the pairs' ends."""
    on = lambda s, c, ext: F.coalesce(F.sum(F.when((F.col("side") == s) & (~F.col("own") if ext else F.lit(True)), c)), F.lit(0))
    found = both_ends(net.edges, "cents", "n_tx").groupBy("gid").agg(
        on("in", F.lit(1).cast("long"), True).alias("in_deg"), on("out", F.lit(1).cast("long"), True).alias("out_deg"),  # pairs are unique
        on("in", F.col("cents"), False).alias("in_cents"), on("out", F.col("cents"), False).alias("out_cents"), on("in", F.col("cents"), True).alias("ext_in_cents"), on("out", F.col("cents"), True).alias("ext_out_cents"),
        on("in", F.col("n_tx"), False).alias("in_tx"), on("out", F.col("n_tx"), False).alias("out_tx"),
    )
    rows = net.nodes.select("gid").join(found, "gid", "left").na.fill(0)
    return rows.withColumn("pass_through", F.when(F.col("ext_in_cents") > 0, six(F.col("ext_out_cents") / F.col("ext_in_cents"))))


def degrees(net: Network) -> DataFrame:
    """(gid, in_deg, out_deg): distinct others that paid or were paid."""
    return turnover(net).select("gid", "in_deg", "out_deg")


def flows(net: Network) -> DataFrame:
    """(gid, in/out cents with and without self-transfers, in/out counts, pass_through)."""
    return turnover(net).drop("in_deg", "out_deg")


def active_days(net: Network) -> DataFrame:
    """(gid, active_days): days with a transfer to or from another node."""
    found = both_ends(net.tx.where("src <> dst"), "day").groupBy("gid").agg(F.count_distinct("day").alias("active_days"))
    return net.nodes.select("gid").join(found, "gid", "left").na.fill(0)


def truncated(net: Network, max_depth: int = 4) -> DataFrame:
    """(gid, truncated): nodes at the last depth without outgoing pairs, whose payments are not observed."""
    return degrees(net).join(net.nodes, "gid").select("gid", ((F.col("depth") == max_depth) & (F.col("out_deg") == 0)).alias("truncated"))


def orphans(net: Network) -> DataFrame:
    """(gid, is_seed) of nodes in no edge, self-transfers included."""
    ends = both_ends(net.edges).select("gid").distinct()
    return net.nodes.join(ends, "gid", "left_anti").select("gid", "is_seed")


def edge_directions(net: Network) -> DataFrame:
    """One row: edges to a smaller depth, to the same depth, and from others to seeds."""
    a = net.nodes.select(F.col("gid").alias("src"), F.col("depth").alias("d1"))
    b = net.nodes.select(F.col("gid").alias("dst"), F.col("depth").alias("d2"), F.col("is_seed").alias("to_seed"))
    n = lambda c: F.sum(c.cast("long"))
    return net.edges.select("src", "dst").join(a, "src").join(b, "dst").agg(n(F.col("d2") < F.col("d1")).alias("backward"), n(F.col("d2") == F.col("d1")).alias("same_depth"), n(F.col("to_seed") & (F.col("d1") > 0)).alias("to_seeds"))


def exact_ids(net: Network) -> DataFrame:
    """One row: ids that a double cannot hold."""
    return net.nodes.agg(F.sum((F.col("gid") != F.col("gid").cast("double").cast("long")).cast("long")).alias("altered"))


def cent_residuals(transactions: DataFrame) -> DataFrame:
    """One row: amounts that are no whole cents, and the largest distance from one."""
    off = F.abs(F.col("sum_kzt") * 100 - F.rint(F.col("sum_kzt") * 100))
    return transactions.agg(F.sum((off > 1e-6).cast("long")).alias("n_off"), six(F.max(off)).alias("max_off"))


def inbound_profile(net: Network) -> DataFrame:
    """What each node received from others: count, payers, sum, largest, days, first and last day."""
    rows = net.tx.where("src <> dst").groupBy(F.col("dst").alias("gid"))
    return rows.agg(F.count("*").alias("n_tx"), F.count_distinct("src").alias("payers"), F.sum("cents").alias("cents"), F.max("cents").alias("largest"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def activity_span(net: Network) -> DataFrame:
    rows = net.tx.select(F.col("src").alias("gid"), "day").unionByName(net.tx.select(F.col("dst").alias("gid"), "day"))
    return rows.groupBy("gid").agg(F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def quantiles(df: DataFrame, column: str, points: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """(p, value): exact quantiles, linear between neighbours."""
    return exact_quantiles(df, column, points).select("p", six(F.col("value")).alias("value"))


def top_edge_share(net: Network, n: int = 50) -> DataFrame:
    """One row: the part of turnover in the n largest pairs."""
    top = net.edges.orderBy(F.desc("cents"), "src", "dst").limit(n).agg(F.sum("cents").alias("top_cents"))
    return top.crossJoin(net.edges.agg(F.sum("cents").alias("all_cents"))).withColumn("share", six(F.col("top_cents") / F.col("all_cents")))


def duplicates(net: Network) -> DataFrame:
    """One row: transactions, distinct ones, and repeats beyond the first."""
    n = net.tx.groupBy("src", "dst", "day", "cents").count()
    return n.agg(F.sum("count").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("count") - 1).alias("repeats"))


def edge_day_stats(net: Network) -> DataFrame:
    """One row: pairs with a single transaction, and pairs active on a single day."""
    per = net.tx.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))
    return per.agg(F.sum((F.col("n") == 1).cast("long")).alias("single_tx"), F.sum((F.col("days") == 1).cast("long")).alias("single_day"), F.max("days").alias("most_days"))


def depth_histogram(net: Network) -> DataFrame:
    a = net.nodes.groupBy("depth").count().withColumn("kind", F.lit("nodes"))
    return a.unionByName(net.edges.groupBy("depth").count().withColumn("kind", F.lit("edges"))).withColumnRenamed("count", "n")


def daily_fanout(net: Network, most: int = 3) -> DataFrame:
    """Each sender's days with the most distinct recipients."""
    days = net.tx.where("src <> dst").groupBy(F.col("src").alias("gid"), "day").agg(F.count_distinct("dst").alias("recipients"), F.count("*").alias("n_tx"), F.sum("cents").alias("cents"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("recipients"), F.desc("cents"), "day"))
    return days.withColumn("rank", rank).where(F.col("rank") <= most)


def paid_once(net: Network) -> DataFrame:
    """(gid, recipients, paid_once): others a sender paid, and those it paid a single time."""
    pairs = net.tx.where("src <> dst").groupBy("src", "dst").count()
    return pairs.groupBy(F.col("src").alias("gid")).agg(F.count("*").alias("recipients"), F.sum((F.col("count") == 1).cast("long")).alias("paid_once"))


def net_balance(net: Network) -> DataFrame:
    """One row: what nodes kept, for all and for those whose in- and outflow are both observed."""
    kept = F.greatest(F.col("ext_in_cents") - F.col("ext_out_cents"), F.lit(0))
    rows = flows(net).join(net.nodes, "gid").join(truncated(net), "gid")
    return rows.agg(F.sum(kept).alias("kept_all"), F.sum(F.when(~F.col("is_seed") & ~F.col("truncated"), kept).otherwise(0)).alias("kept_observed"))


def ratio_candidates(net: Network, low: float = 0.8, high: float = 1.2) -> DataFrame:
    rows = flows(net).join(net.nodes, "gid").join(truncated(net), "gid").where(~F.col("is_seed") & ~F.col("truncated"))
    return rows.where((F.col("ext_in_cents") > 0) & (F.col("ext_out_cents") > 0) & F.col("pass_through").between(low, high)).select("gid", "pass_through")


def calendar(net: Network) -> DataFrame:
    """(weekday, n_tx, days): transactions and observed days by weekday, Sunday as 1."""
    return net.tx.groupBy(F.dayofweek("day").alias("weekday")).agg(F.count("*").alias("n_tx"), F.count_distinct("day").alias("days"))


def run_summary(net: Network, components: DataFrame) -> DataFrame:
    """One row of totals."""
    nodes = net.nodes.agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_seed").cast("long")).alias("n_seeds"))
    edges = net.edges.agg(F.count("*").alias("n_edges"))
    tx = net.tx.agg(F.count("*").alias("n_tx"), F.sum("cents").alias("turnover_cents"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    lone, cutoff = orphans(net).agg(F.count("*").alias("n_isolates")), truncated(net).agg(F.sum(F.col("truncated").cast("long")).alias("n_truncated"))
    return nodes.crossJoin(edges).crossJoin(tx).crossJoin(lone).crossJoin(cutoff).crossJoin(components.agg(F.count_distinct("component_id").alias("n_components")))


def export_ordinals(net: Network) -> DataFrame:
    """(row_id, src, dst, day, cents): places from 0 in the order (day, src, dst, cents), without a window over all rows or a whole day."""
    return sums_before(net.tx, ["day", "src", "dst", "cents"], row_id=F.lit(1).cast("long")).select("row_id", "src", "dst", "day", "cents")


def starter_ratio(net: Network) -> DataFrame:
    """(gid, pass_through): outflow over inflow, self-transfers included; null without inflow."""
    return flows(net).select("gid", F.when(F.col("in_cents") > 0, six(F.col("out_cents") / F.col("in_cents"))).alias("pass_through"))


def boundary_medians(net: Network) -> DataFrame:
    """(place, n, in_cents, in_tx): medians of inflow at the last depth and, above it, of nodes that paid no one."""
    rows = flows(net).join(net.nodes.select("gid", "depth", "is_seed"), "gid").join(degrees(net).select("gid", "out_deg"), "gid").join(truncated(net), "gid").where("not is_seed and out_deg = 0 and ext_in_cents > 0")
    place = F.when(F.col("truncated"), F.lit("boundary")).otherwise(F.lit("interior"))
    rows = cut(rows.select(place.alias("place"), "in_cents", "in_tx"), "boundary")
    half = lambda c: exact_quantiles(rows, c, (0.5,), ("place",)).select("place", F.col("value").alias(c))
    return rows.groupBy("place").agg(F.count("*").alias("n")).join(half("in_cents"), "place").join(half("in_tx"), "place")
