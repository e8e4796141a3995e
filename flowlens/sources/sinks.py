"""Exports: typed Parquet with a manifest that is written last, CSV for people, and table digests."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import Network

FORMAT = 1


def digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or partitioning: of the sums of row hashes."""
    cols = sorted(df.columns)
    rows = df.select(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.to_json(F.struct(c)), F.lit("null")) for c in cols]), 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(5)]
    row = rows.agg(F.count("*").alias("n"), *sums).first()
    return hashlib.sha256(json.dumps([cols, *map(str, row)]).encode()).hexdigest()


def canonical(net: Network) -> Network:
    """The tables in their order for export: nodes by id, edges by pair, transactions by day, pair and amount."""
    return Network(net.nodes.orderBy("gid"), net.edges.orderBy("src", "dst"), net.tx.orderBy("day", "src", "dst", "cents"))


def write_csv(df: DataFrame, path: str, quote_all: bool = False, order: tuple[str, ...] = ()) -> None:
    """CSV with a header; floats with six digits, arrays and structs as JSON, ids as they are; files in turn hold the rows by `order`."""
    cols = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            cols.append(F.when(F.col(name).isNotNull(), F.format_string("%.6f", F.col(name))).alias(name))
        elif kind.startswith(("array", "struct", "map")):
            cols.append(F.to_json(name).alias(name))
        else:
            cols.append(F.col(name))
    df = df.orderBy(*order) if order else df
    df.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("lineSep", "\n").csv(path)


def write_list(df: DataFrame, path: str, columns: tuple[str, ...] = ("rank", "gid", "role", "priority_score", "why"), order: str = "rank") -> None:
    """A list for spreadsheets, one file: byte order mark, CRLF, every field quoted. df is a page of rows, not a table."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = df.select(F.col(order).alias("_o"), F.concat_ws(",", *map(quoted, columns)).alias("value"))
    head = df.sparkSession.createDataFrame([("\ufeff" + ",".join(columns),)], "value string").select(F.lit(None).alias("_o"), "value")
    both = head.unionByName(lines).repartition(1).sortWithinPartitions(F.asc_nulls_first("_o"))
    both.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def snapshot_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) of a snapshot's tables among themselves: pairs given more than once, pairs whose transactions do not add
    up to their cents and count, and nodes whose turnover and counts are not those of their pairs."""
    edges, tx, nodes = tables["edges"], tables["transactions"], tables["nodes"]
    n = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    pairs = edges.groupBy("src", "dst").agg(F.sum("cents").alias("cents"), F.sum("n_tx").alias("n"), F.count("*").alias("rows"))
    sums = tx.groupBy("src", "dst").agg(F.sum("cents").alias("tx_cents"), F.count("*").alias("tx_n"))
    apart = pairs.join(sums, ["src", "dst"], "full").where(~(F.col("cents").eqNullSafe(F.col("tx_cents")) & F.col("n").eqNullSafe(F.col("tx_n"))))
    side = lambda end, name: pairs.select(F.col(end).alias("gid"), *[(F.col(c) if name == k else F.lit(0).cast("long")).alias(f"e_{k}_{v}") for k in ("in", "out") for c, v in (("cents", "cents"), ("n", "tx"))])
    ends = side("dst", "in").unionByName(side("src", "out")).groupBy("gid").agg(*[F.sum(f"e_{k}_{v}").alias(f"e_{k}_{v}") for k in ("in", "out") for v in ("cents", "tx")])
    same = F.lit(True)
    for k in ("in_cents", "out_cents", "in_tx", "out_tx"):
        same = same & F.coalesce(F.col(k), F.lit(0)).eqNullSafe(F.coalesce(F.col(f"e_{k}"), F.lit(0)))
    return n("repeated_pairs", pairs.where("rows > 1")).unionByName(n("pair_totals", apart)).unionByName(n("node_totals", nodes.join(ends, "gid", "full").where(~same | F.col("in_cents").isNull())))


def write_snapshot(spark: SparkSession, path: str, net: Network, scored: DataFrame, clusters: DataFrame, top: DataFrame, config: dict) -> dict:
    """Write the tables below path, a record of each node's figures as JSON lines (`metrics`) and one of the run (`run`: configuration,
    rows and seconds), then the manifest: a reader that finds a manifest finds all it names.

    Ids are strings in JSON only. Returns the manifest.
    """
    began = time.time()
    parts = {"nodes": scored, "edges": net.edges, "transactions": net.tx, "clusters": clusters, "top": top}
    manifest = {"format": FORMAT, "config": config, "tables": {}}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        kept = spark.read.parquet(f"{path}/{name}")
        manifest["tables"][name] = {"rows": kept.count(), "digest": digest(kept)}
    said = [F.col(c).cast("string").alias(c) if c == "gid" else F.col(c) for c in scored.columns]
    scored.select(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/metrics")
    line = lambda record: spark.createDataFrame([(json.dumps(record, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite")
    line({"config": config, "rows": {name: t["rows"] for name, t in manifest["tables"].items()}, "total_seconds": round(time.time() - began, 3)}).text(f"{path}/run")
    line(manifest).text(f"{path}/manifest")
    return manifest


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(total_seconds double, config string, rows string) of the run record of a snapshot, for check_run."""
    return spark.read.text(f"{path}/run").select(F.get_json_object("value", "$.total_seconds").cast("double").alias("total_seconds"), F.get_json_object("value", "$.config").alias("config"), F.get_json_object("value", "$.rows").alias("rows"))


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables it names; digests are checked, and then that transactions, pairs and nodes agree."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest.get("format") != FORMAT:
        raise ValueError("unknown snapshot format")
    found = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, df in found.items():
        if digest(df) != manifest["tables"][name]["digest"]:
            raise ValueError(f"{name}: rows differ from the manifest")
    faults = {r["check"]: r["violations"] for r in snapshot_faults(found).collect() if r["violations"]}
    if faults:
        raise ValueError(f"tables disagree: {faults}")
    return manifest, found
