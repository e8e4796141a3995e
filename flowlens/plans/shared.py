"""Written tables that cut lineage, and joins whose small side is checked before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a lookup table that may be broadcast; a wider table takes the shuffled join.
BROADCAST_ROWS = 50_000
#: And what its rows may hold, as JSON.
BROADCAST_BYTES = 32 << 20
_WRITTEN: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if driver and
    executors are one local process; on a cluster that is an error, since no default is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="flowlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: what a cache must be keyed by, besides the path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later plans start at files, not at df's plan.

    A lost executor then costs a re-read, and every reader sees the same rows even if df is not deterministic.
    """
    path = f"{shared_dir(df.sparkSession)}/flowlens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(made)] = (weakref.ref(made), path)
    return made


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that cut has written and that nothing reads any more, as a loop's last round once the next
    one is written. Tables that are no result of cut are left alone."""
    for df in tables:
        ref, path = _WRITTEN.pop(id(df), (lambda: None, ""))
        if ref() is df:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def cut_and_sum(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """cut, and aggregates of the rows that were written, taken while they are: no second pass over the table."""
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    return cut(df.observe(seen, *[v.alias(k) for k, v in sums.items()]), label), seen.get


def lookup_join(df: DataFrame, small: DataFrame, on: str | Column | list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join df with a table expected to be small. small must be cheap to count (a cut table).

    It is broadcast only if it has at most `limit` rows and BROADCAST_BYTES; otherwise the join shuffles and AQE splits hot keys.
    """
    size = small.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))), F.lit(0)).alias("b")).first()
    few = size["n"] <= limit and size["b"] <= BROADCAST_BYTES
    return df.join(F.broadcast(small) if few else small, on, how)


def sums_before(df: DataFrame, order: list[str | Column], **sums: Column) -> DataFrame:
    """df with the sum of each of `sums` over all rows before a row in the given total order; 0 before the first.

    No window without a partition: rows are dealt into ranges of the order and written, the ranges' sums are added up
    (a row for each range), and rows are summed within their range. Sums of longs are exact.
    """
    ranged = cut(df.repartitionByRange(*order).select("*", *[v.alias(f"_add_{k}") for k, v in sums.items()], F.spark_partition_id().alias("_range")), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_add_{k}").alias(f"_all_{k}") for k in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = ranged.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_add_{k}").over(inside), F.lit(0)) for k in sums}).join(F.broadcast(offsets), "_range")
    return made.select(*df.columns, *[(F.col(f"_off_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])


def let(value: Column, body) -> Column:
    """Evaluate value once per row and pass it to body; keeps Catalyst from inlining it into a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
