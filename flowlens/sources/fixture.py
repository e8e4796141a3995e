"""A transfer network derived from the events table, in whole-number arithmetic."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.plans.shared import cut, shared_dir, table_version
from flowlens.sources.tables import Network, as_network

MAX_DEPTH = 4
_LAID: dict[tuple, str] = {}
_MADE: dict[tuple, dict[str, DataFrame]] = {}


def transfers(events: DataFrame) -> tuple[DataFrame, int]:
    """(src, dst, cents, day) of the purchases, and the number of ids."""
    n = (events.agg(F.max("user_id")).first()[0] or 0) + 1
    u, k = F.col("u"), F.col("k")
    rows = events.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.regexp_extract("props", r"([0-9]+)", 1).try_cast("bigint").alias("k"), F.to_date("ts").alias("day"), "value")
    rows = rows.where(~((u % 11 == 0) & (u % 28 != 0)))
    to = F.when(k % 5 == 0, (2 * u + 1) % n).when(k % 5 == 1, (u + 1) % n).when(k % 5 == 2, (7 * u + 3) % n).when(k % 5 == 3, F.floor(u / 10) * 10).otherwise((u * u + 5) % n)
    return rows.select(u.alias("src"), to.cast("long").alias("dst"), (F.lit(500000) + 100000 * F.floor(F.col("value") / 25)).cast("long").alias("cents"), "day"), n


def hops(pairs: DataFrame, seeds: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """(gid, depth): breadth-first distance from the nearest seed, up to most."""
    state = seeds.select("gid", F.lit(0).alias("depth"))
    for d in range(1, most + 1):
        # a node's own row goes round again beside those it leads to, so a round is one join and one aggregation
        ahead = state.where(F.col("depth") == d - 1).join(pairs, F.col("gid") == F.col("src")).select(F.col("dst").alias("gid"), F.lit(d).alias("depth"))
        state = cut(state.unionByName(ahead).groupBy("gid").agg(F.min("depth").alias("depth")), "hops")
    return state


def derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes, edges and transactions in the input layout."""
    moved, n = transfers(spark.read.parquet(f"{sf_dir}/events.parquet"))
    moved = cut(moved, "transfers")
    seeds = moved.where("src % 28 = 0").select(F.col("src").alias("gid")).distinct()
    depth = hops(cut(moved.select("src", "dst").distinct(), "pairs"), seeds)
    lone = spark.range(n, n + -(-n // 50)).select(F.col("id").alias("gid"), F.lit(0).alias("depth"))
    nodes = depth.unionByName(lone).select("gid", "depth", (F.col("depth") == 0).alias("is_seed"))
    sent = moved.join(depth.where(F.col("depth") < MAX_DEPTH), F.col("src") == F.col("gid"))
    transactions = sent.select("src", "dst", F.col("day").alias("date"), (F.col("cents") / 100).alias("sum_kzt"))
    edges = sent.groupBy("src", "dst", "depth").agg((F.sum("cents") / 100).alias("sum_kzt"), F.count("*").alias("n_tx"))
    return {"nodes": nodes, "edges": edges.select("src", "dst", "sum_kzt", "n_tx", (F.col("depth") + 1).alias("depth")), "transactions": transactions}


def made_from(spark: SparkSession, sf_dir: str) -> tuple:
    """What tables derived in this session are keyed by: the events as they are now."""
    return spark.sparkContext.applicationId, sf_dir, table_version(spark, f"{sf_dir}/events.parquet")


def raw_network(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables, written once for each session and folder."""
    key = made_from(spark, sf_dir)
    if key not in _MADE:
        made = derive(spark, sf_dir)
        with ThreadPoolExecutor(len(made)) as pool:  # independent jobs: their small stages fill the cores together
            _MADE[key] = dict(zip(made, pool.map(cut, made.values(), made), strict=True))
    return _MADE[key]


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder in which a derived table lies."""
    return raw_network(spark, sf_dir)[name].inputFiles()[0].rpartition("/")[0]


def network(spark: SparkSession, sf_dir: str) -> Network:
    return as_network(**raw_network(spark, sf_dir))


def spoiled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables with faults of every kind that validation counts, placed by whole-number rules on ids."""
    raw = raw_network(spark, sf_dir)
    n, e, t = raw["nodes"], raw["edges"], raw["transactions"]
    of = lambda k: F.col("gid") % 10 == k
    pair = lambda k: (F.col("src") + F.col("dst")) % 10 == k
    nodes = n.unionByName(n.where(of(3))).select(
        F.when(of(4), -F.col("gid") - 1).otherwise(F.col("gid")).alias("gid"), F.when(of(1), F.col("depth") + 5).when(of(5), None).otherwise(F.col("depth")).alias("depth"), F.when(of(2), ~F.col("is_seed")).otherwise(F.col("is_seed")).alias("is_seed")
    )
    edges = e.unionByName(e.where(pair(3))).select(
        "src", "dst", F.when(pair(2), F.col("sum_kzt") + 0.004).when(pair(5), None).otherwise(F.col("sum_kzt")).alias("sum_kzt"), F.when(pair(1), 0).otherwise(F.col("n_tx")).alias("n_tx"), F.when(pair(4), 9).otherwise(F.col("depth")).alias("depth")
    )
    tx = t.select("src", F.when(pair(8), F.col("dst") + 1_000_000).otherwise(F.col("dst")).alias("dst"), F.when(pair(7), None).when(pair(9), F.concat(F.col("date").cast("string"), F.lit("T10:00:00+05:00"))).otherwise(F.col("date").cast("string")).alias("date"), F.when(pair(6), -1.0).otherwise(F.col("sum_kzt")).alias("sum_kzt"))
    return {"nodes": nodes, "edges": edges, "transactions": tx}


def layout(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the derived tables as nodes.parquet, edges.parquet and transactions.parquet, written once for each session and folder."""
    key = made_from(spark, sf_dir)
    if key not in _LAID:
        path = f"{shared_dir(spark)}/flowlens/layout-{uuid.uuid4().hex}"
        for name, df in raw_network(spark, sf_dir).items():
            df.write.parquet(f"{path}/{name}.parquet")
        _LAID[key] = path
    return _LAID[key]
