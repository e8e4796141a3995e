"""Contract checks of the input tables and reconciliation of pair totals with transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.sources.tables import Network

LIMIT = 1 << 53


def _bad(**checks):
    return [F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for k, c in checks.items()]


def violations(nodes: DataFrame, edges: DataFrame, transactions: DataFrame) -> DataFrame:
    """(check, violations): one aggregation for each table, one for each key and reference check."""
    null = lambda *cs: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cs])
    money = lambda: F.isnan("sum_kzt") | (F.col("sum_kzt") < 0) | (F.abs(F.col("sum_kzt") * 100 - F.rint(F.col("sum_kzt") * 100)) >= 0.001) | (F.col("sum_kzt") * 100 >= LIMIT)
    long = lambda df: df.unpivot([], df.columns, "check", "violations")
    of_nodes = nodes.agg(*_bad(nodes_null=null("gid", "depth", "is_seed"), nodes_gid=F.col("gid") < 0, nodes_depth=~F.col("depth").between(0, 4), nodes_seed=F.col("is_seed") != (F.col("depth") == 0)))
    of_edges = edges.agg(*_bad(edges_null=null("src", "dst", "sum_kzt", "n_tx", "depth"), edges_depth=~F.col("depth").between(1, 4), edges_count=F.col("n_tx") <= 0, edges_money=money()))
    of_tx = transactions.agg(*_bad(tx_null=null("src", "dst", "date", "sum_kzt"), tx_money=money(), tx_date=F.try_to_timestamp(F.col("date").cast("string")).isNull()))
    ends = edges.select(F.col("src").alias("gid")).unionByName(edges.select(F.col("dst").alias("gid")))
    ends = ends.unionByName(transactions.select(F.col("src").alias("gid"))).unionByName(transactions.select(F.col("dst").alias("gid"))).distinct()
    keys = lambda df, cols, name: df.groupBy(*cols).count().where("count > 1").agg(F.count("*").alias(name))
    # texts of dates that end in different offsets from UTC name no common calendar day
    zone = F.regexp_extract(F.col("date").cast("string"), r"[0-9:.](Z|[+-][0-9]{2}:?[0-9]{2})$", 1)
    of_zones = transactions.agg(F.greatest(F.count_distinct(F.when(F.col("date").isNotNull(), zone)) - 1, F.lit(0)).alias("tx_zones"))
    parts = [of_nodes, of_edges, of_tx, of_zones, keys(nodes, ["gid"], "nodes_unique"), keys(edges, ["src", "dst"], "edges_unique"), ends.join(nodes, "gid", "left_anti").agg(F.count("*").alias("ids_known"))]
    return reduce(DataFrame.unionByName, map(long, parts))


def pair_totals(tx: DataFrame) -> DataFrame:
    return tx.groupBy("src", "dst").agg(F.sum("cents").alias("tx_cents"), F.count("*").alias("tx_count"))


def pair_match(net: Network) -> DataFrame:
    """Edges and transaction totals side by side, whichever of them exists."""
    return net.edges.select("src", "dst", "cents", "n_tx").join(pair_totals(net.tx), ["src", "dst"], "full_outer")


def reconcile(net: Network) -> DataFrame:
    """One row: pairs, those on one side only, and those whose sums or counts differ."""
    both = F.col("cents").isNotNull() & F.col("tx_cents").isNotNull()
    return pair_match(net).agg(
        F.count("*").alias("pairs"),
        *_bad(only_tx=F.col("cents").isNull(), only_edges=F.col("tx_cents").isNull(), cents_differ=both & (F.col("cents") != F.col("tx_cents")), counts_differ=both & (F.col("n_tx") != F.col("tx_count"))),
    )


def weak_reconcile(net: Network) -> DataFrame:
    """Presence only: pairs that either table lacks."""
    a, b = net.edges.select("src", "dst"), net.tx.select("src", "dst").distinct()
    return a.join(b, ["src", "dst"], "left_anti").withColumn("lacks", F.lit("tx")).unionByName(b.join(a, ["src", "dst"], "left_anti").withColumn("lacks", F.lit("edges"))).groupBy("lacks").count()


def warnings(net: Network) -> DataFrame:
    """One row of notes on the data: small amounts, several months, self-transfers."""
    return net.tx.agg(F.max(F.col("cents") < 500000).alias("below_5000"), (F.count_distinct(F.trunc("day", "month")) > 1).alias("several_months"), F.max(F.col("src") == F.col("dst")).alias("self_transfers"))
