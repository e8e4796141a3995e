"""Concrete patterns for review: money that went round, repeated amounts, busy days."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.flows import both_ends
from flowlens.operators.paths import cycles
from flowlens.plans.shared import cut
from flowlens.sources.tables import Network


def first_transfers(net: Network) -> DataFrame:
    """(src, dst, day, cents, n_tx): each pair's earliest transfer, smallest first, and its number of transfers."""
    first = net.tx.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("day", "cents")).alias("t"), F.count("*").alias("n_tx"))
    return first.select("src", "dst", "t.day", "t.cents", "n_tx")


def _agreement(low: Column, high: Column) -> Column:
    return F.when(high > 0, F.rint(low * 10000.0 / high) / 10000).otherwise(0.0)


#: Agreements at which the search for best cycles stops to settle nodes.
LEVELS = (1.0, 0.5, 0.0)


def cycles_through(links: DataFrame, open_: DataFrame, least: float, longest: int = 6) -> DataFrame:
    """(members, low, high): cycles with a node of `open_` (gid) whose smallest amount is at least about `least` of the largest, each once.

    links: (src, dst, cents). Rooted at the smallest open member; two half paths meet, as in paths.cycles, and a half that is already
    less equal than `least` is not grown, since more links cannot bring its amounts closer.
    """
    marks = open_.select(F.col("gid").alias("dst"), F.lit(True).alias("open"))
    to_open = cut(links.join(marks, "dst", "left").join(marks.select(F.col("dst").alias("src"), F.col("open").alias("from_open")), "src", "left").select("src", "dst", "cents", F.coalesce("open", F.lit(False)).alias("dst_open"), F.coalesce("from_open", F.lit(False)).alias("src_open")), "open")
    near = F.col("low") >= (least - 0.0001) * F.col("high")
    free = lambda end: ~F.col(f"{end}_open") | (F.col(end) > F.col("root"))
    wider = [F.least("low", "cents").alias("low"), F.greatest("high", "cents").alias("high")]
    one = [F.col("cents").alias("low"), F.col("cents").alias("high")]
    ahead = [to_open.where("src_open").select(F.col("src").alias("root"), "dst", "dst_open", *one).where(free("dst")).select("root", F.col("dst").alias("cur"), F.array("dst").alias("fore"), "low", "high")]
    behind = [to_open.where("dst_open").select(F.col("dst").alias("root"), "src", "src_open", *one).where(free("src")).select("root", F.col("src").alias("cur"), F.array().cast("array<bigint>").alias("aft"), "low", "high")]

    def further() -> DataFrame:
        grown = ahead[-1].join(to_open, F.col("cur") == F.col("src")).where(free("dst") & (F.col("dst") != F.col("root")) & ~F.array_contains("fore", F.col("dst")))
        return cut(grown.select("root", F.col("dst").alias("cur"), F.concat("fore", F.array("dst")).alias("fore"), *wider).where(near), "ahead")

    def back() -> DataFrame:
        grown = behind[-1].join(to_open, F.col("cur") == F.col("dst")).where(free("src") & (F.col("src") != F.col("root")) & (F.col("src") != F.col("cur")) & ~F.array_contains("aft", F.col("src")))
        return cut(grown.select("root", F.col("src").alias("cur"), F.concat(F.array("cur"), "aft").alias("aft"), *wider).where(near), "behind")

    with ThreadPoolExecutor(2) as pool:  # both halves grow at once
        while len(ahead) + len(behind) < longest:
            jobs = [(ahead, pool.submit(further))] + ([(behind, pool.submit(back))] if len(ahead) + len(behind) + 1 < longest else [])
            for half, job in jobs:
                half.append(job.result())
    found = None
    for n in range(2, longest + 1):
        a, b = ahead[(n + 1) // 2 - 1], behind[n // 2 - 1]
        met = a.join(b.select("root", "cur", "aft", F.col("low").alias("low2"), F.col("high").alias("high2")), ["root", "cur"]).where(~F.arrays_overlap("fore", "aft"))
        closed = met.select(F.concat(F.array("root"), "fore", "aft").alias("members"), F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")).where(near)
        found = closed if found is None else found.unionByName(closed)
    at = F.array_position("members", F.array_min("members")).cast("int")
    turned = F.concat(F.slice("members", at, F.size("members")), F.slice("members", F.lit(1), at - 1))
    return found.select(turned.alias("members"), "low", "high").where(_agreement(F.col("low"), F.col("high")) >= least)


def described(found: DataFrame, first: DataFrame) -> DataFrame:
    """(members, length, agreement, span_days, first_day, last_day, legs) of cycles (members), by each hop's earliest transfer."""
    found = cut(found.select("members", F.size("members").alias("length"), F.monotonically_increasing_id().alias("id")), "cycles")
    hop = found.select("id", "length", "members", F.posexplode("members").alias("i", "src"))
    hop = hop.withColumn("dst", F.element_at("members", F.when(F.col("i") + 1 < F.col("length"), F.col("i") + 2).otherwise(1)))
    legs = hop.join(first, ["src", "dst"]).groupBy("id").agg(
        F.first("members").alias("members"), F.first("length").alias("length"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.sort_array(F.collect_list(F.struct("i", "src", "dst", "day", "cents", "n_tx"))).alias("legs"),
    )
    return legs.where(F.size("legs") == F.col("length")).select("members", "length", _agreement(F.col("low"), F.col("high")).alias("agreement"), F.datediff("last_day", "first_day").alias("span_days"), "first_day", "last_day", "legs")


def described_cycles(net: Network, longest: int = 6) -> DataFrame:
    """(members, length, agreement, span_days, first_day, last_day, legs) of each cycle."""
    return described(cycles(net, longest), first_transfers(net))


def best_cycles(net: Network, longest: int = 6, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(gid, ...): of the cycles through a node, the one of most equal amounts, then shortest span, then fewest members.

    Best first, without listing all cycles: at each level of agreement only cycles that reach it and pass an open node are grown,
    and the nodes on them are settled, since no cycle that is left could be better. The last level is for the rest.
    """
    first = cut(first_transfers(net), "first")
    links = first.select("src", "dst", "cents")
    open_, best = net.links.select(F.col("src").alias("gid")).distinct().join(net.links.select(F.col("dst").alias("gid")).distinct(), "gid"), None
    for k, level in enumerate(levels):
        open_ = cut(open_, "opennodes")
        found = described(cycles_through(links, open_, level, longest), first)
        names = F.transform("members", lambda m: m.cast("string"))
        each = found.withColumn("names", names).select("*", F.explode("members").alias("gid")).join(open_, "gid", "left_semi")
        rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("agreement"), "span_days", "length", "names"))
        settled = cut(each.withColumn("r", rank).where("r = 1").drop("r", "names"), "settled")
        best = settled if best is None else best.unionByName(settled)
        if k + 1 < len(levels):
            open_ = open_.join(settled.select("gid"), "gid", "left_anti")
            if open_.isEmpty():
                break
    return best


def repeated_amounts(net: Network, least: int = 3) -> DataFrame:
    """(src, dst, cents, n): amounts that one node sent another at least `least` times."""
    return net.tx.where("src <> dst").groupBy("src", "dst", "cents").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def best_repeats(net: Network, least: int = 3) -> DataFrame:
    rows = repeated_amounts(net, least).select("*", F.explode(F.array(F.struct(F.col("src").alias("gid"), F.lit("src").alias("side")), F.struct(F.col("dst").alias("gid"), F.lit("dst").alias("side")))).alias("e")).select("src", "dst", "cents", "n", "e.*")
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("n"), F.desc("cents"), F.col("src").cast("string"), F.col("dst").cast("string")))
    return rows.withColumn("r", rank).where("r = 1").drop("r")


def bursts(net: Network, least: int = 5) -> DataFrame:
    """(gid, day, side, n): days on which a node sent or received at least `least` transfers; a self-transfer is sent once."""
    rows = both_ends(net.tx, "day").where("side = 'out' or not own")
    return rows.groupBy("gid", "day", "side").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def best_bursts(net: Network, least: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("n"), "day", "side"))
    return bursts(net, least).withColumn("r", rank).where("r = 1").drop("r")


def detect(net: Network, longest: int = 6) -> DataFrame:
    """(gid, motifs, leading, cycle, repeat, burst, summary) of nodes with a motif: at most one example of each kind."""
    c = best_cycles(net, longest).select("gid", F.struct("members", "length", "agreement", "span_days", "first_day", "last_day", "legs").alias("cycle"))
    r = best_repeats(net).select("gid", F.struct("src", "dst", "cents", "n", "side").alias("repeat"))
    b = best_bursts(net).select("gid", F.struct("day", "side", "n").alias("burst"))
    rows = c.join(r, "gid", "full_outer").join(b, "gid", "full_outer")
    named = F.array_compact(F.array(F.when(F.col("burst").isNotNull(), F.lit("burst")), F.when(F.col("cycle").isNotNull(), F.lit("cycle")), F.when(F.col("repeat").isNotNull(), F.lit("repeat_amount"))))
    rows = rows.withColumn("motifs", named).withColumn("leading", F.when(F.col("cycle").isNotNull(), F.lit("cycle")).otherwise(F.element_at("motifs", 1)))
    text = (
        F.when(F.col("leading") == "cycle", F.format_string("money came back through %s nodes within %s days", F.col("cycle.length"), F.col("cycle.span_days")))
        .when(F.col("leading") == "burst", F.format_string("%s transfers on %s", F.col("burst.n"), F.col("burst.day").cast("string")))
        .otherwise(F.format_string("%s transfers of exactly %.2f to one partner", F.col("repeat.n"), F.col("repeat.cents") / 100))
    )
    return rows.withColumn("summary", text)
