"""Independent checks of exported tables against the inputs: each a count of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.flows import degrees, flows, truncated
from flowlens.operators.roles import ROLES
from flowlens.sources.tables import Network


def _n(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def _differ(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks."""
    return _n(name, a.exceptAll(b).unionByName(b.exceptAll(a)))


def check_outputs(rows: DataFrame, clusters: DataFrame, top: DataFrame) -> DataFrame:
    """(check, violations) of the three outputs among themselves."""
    ids = rows.select("gid")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_seed").cast("long")).alias("n_seed"))
    best = rows.orderBy(F.desc("priority_score"), "gid").limit(top.count()).select("gid", "role", "priority_score")
    parts = [
        _n("unique_ids", ids.groupBy("gid").count().where("count > 1")),
        _n("known_role", rows.where(~F.col("role").isin(*ROLES, "peripheral"))),
        _n("score_range", rows.where(~F.col("role_score").between(0, 1) | ~F.col("priority_score").between(0, 1))),
        _n("truncated_cap", rows.where(F.col("truncated") & (F.col("role_score") > 0.6))),
        _n("reason_with_role", rows.where((F.col("role") == "peripheral") == (F.col("peripheral_reason") == ""))),
        _differ("cluster_sizes", clusters.select("cluster_id", "n_nodes", "n_seed"), sizes),
        _n("cluster_leaders", clusters.select("cluster_id", F.explode("top_gids").alias("gid")).join(rows.select("gid", "cluster_id"), ["gid", "cluster_id"], "left_anti")),
        _differ("top_order", top.select("gid", "role", "priority_score"), best),
        _n("top_ranks", top.groupBy("rank").count().where("count > 1")),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_against_inputs(net: Network, rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(check, violations) of exported node and cluster figures against figures made again from the inputs."""
    at = lambda end: rows.select(F.col("gid").alias(end), F.col("cluster_id").alias(f"c_{end}"))
    inside = net.edges.join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("cluster_id")).agg(F.sum("cents").alias("internal_cents"))
    parts = [
        _differ("nodes", rows.select("gid", "depth", "is_seed"), net.nodes),
        _differ("degrees", rows.select("gid", "in_deg", "out_deg"), degrees(net)),
        _differ("turnover", rows.select("gid", "in_cents", "out_cents", "in_tx", "out_tx"), flows(net).select("gid", "in_cents", "out_cents", "in_tx", "out_tx")),
        _differ("truncation", rows.select("gid", "truncated"), truncated(net)),
        _differ("cluster_turnover", clusters.where("internal_cents > 0").select("cluster_id", "internal_cents"), inside.where("internal_cents > 0")),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_run(run: DataFrame, most_seconds: float = 300.0) -> DataFrame:
    """(check, violations) of run records (total_seconds): times that are missing, no numbers, negative or above the cap."""
    t = F.col("total_seconds").cast("double")
    return _n("run_time", run.where(t.isNull() | F.isnan(t) | ~t.between(0, most_seconds)))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path) of input files that came, went or differ between two tables of file_digests."""
    both = before.select("path", F.col("sha256").alias("was")).join(after.select("path", "sha256"), "path", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("sha256"))).select("path")
