"""The three tables of a transfer network: schemas, reading, and the amounts and days that operators use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = {
    "nodes": ("gid", "depth", "is_seed"),
    "edges": ("src", "dst", "sum_kzt", "n_tx", "depth"),
    "transactions": ("src", "dst", "date", "sum_kzt"),
}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class DataError(ValueError):
    """An input table breaks its contract."""


@dataclass(frozen=True)
class Network:
    """nodes(gid, depth, is_seed), edges(src, dst, cents, n_tx, depth), tx(src, dst, day, cents)."""

    nodes: DataFrame
    edges: DataFrame
    tx: DataFrame

    @property
    def links(self) -> DataFrame:
        """Edges without self-transfers."""
        return self.edges.where("src <> dst")


def cents(amount: Column) -> Column:
    """Minor units, half-even."""
    return F.rint(amount * 100).cast("long")


def require_types(name: str, df: DataFrame) -> None:
    """Reject missing columns and types that would need coercion; looks at the schema alone."""
    missing = [c for c in COLUMNS[name] if c not in df.columns]
    if missing:
        raise DataError(f"{name}: missing columns {missing}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in ("gid", "src", "dst", "depth", "n_tx"):
        if c in COLUMNS[name] and not isinstance(kinds[c], WHOLE) and not (isinstance(kinds[c], T.DecimalType) and kinds[c].scale == 0):
            raise DataError(f"{name}.{c}: whole numbers are required, not {kinds[c].simpleString()}")
    if name == "nodes" and not isinstance(kinds["is_seed"], T.BooleanType):
        raise DataError("nodes.is_seed: booleans are required")
    if name == "transactions" and isinstance(kinds["date"], (T.NumericType, T.BooleanType)):
        raise DataError("transactions.date: dates or ISO strings are required")
    if "sum_kzt" in COLUMNS[name] and not isinstance(kinds["sum_kzt"], T.NumericType):
        raise DataError(f"{name}.sum_kzt: numbers are required")


def read_raw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables as they are, types checked."""
    found = {name: spark.read.parquet(f"{path}/{name}.parquet") for name in COLUMNS}
    for name, df in found.items():
        require_types(name, df)
    return found


def as_network(nodes: DataFrame, edges: DataFrame, transactions: DataFrame) -> Network:
    """Typed tables with amounts in cents and days as dates; narrow projections, so scans stay pruned."""
    return Network(
        nodes.select(F.col("gid").cast("long").alias("gid"), F.col("depth").cast("int").alias("depth"), "is_seed"),
        edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), cents(F.col("sum_kzt")).alias("cents"), F.col("n_tx").cast("long").alias("n_tx"), F.col("depth").cast("int").alias("depth")),
        transactions.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.to_date("date").alias("day"), cents(F.col("sum_kzt")).alias("cents")),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file below path, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+/?[^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
