"""First-in-first-out matching of what nodes receive and send, by day, as a fold inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.flows import both_ends, six
from flowlens.sources.tables import Network

QUEUE = "array<struct<day:int,amt:bigint>>"


def daily_flows(net: Network, self_transfers: bool = False) -> DataFrame:
    """(gid, days): each node's days in order, with cents in and out; summed by day before rows meet."""
    tx = net.tx if self_transfers else net.tx.where("src <> dst")
    on = lambda s: F.sum(F.when(F.col("side") == s, F.col("cents")).otherwise(0)).alias(s)
    days = both_ends(tx, "day", "cents").groupBy("gid", F.unix_date("day").alias("day")).agg(on("in"), on("out"))
    return days.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("day", "in", "out"))).alias("days"))


def fold(days: Column, window: int, min_lag: int = 0) -> Column:
    """Struct (matched, same_day): cents sent that inflow of min_lag to window days before covers, oldest first.

    The queue never holds more than window + 1 days.
    """
    none = F.array().cast(QUEUE)
    start = F.struct(none.alias("queue"), F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("same_day"))

    def step(a: Column, e: Column) -> Column:
        entry = lambda d, x: F.struct(d.cast("int").alias("day"), x.cast("bigint").alias("amt"))
        queue = F.concat(F.filter(a["queue"], lambda q: q["day"] >= e["day"] - window), F.when(e["in"] > 0, F.array(entry(e["day"], e["in"]))).otherwise(none))
        ripe = lambda q: q["day"] <= e["day"] - min_lag
        before = lambda i: F.aggregate(F.slice(queue, 1, i), F.lit(0).cast("long"), lambda s, q: s + q["amt"])
        used = lambda q, i: F.when(ripe(q), F.least(q["amt"], F.greatest(e["out"] - before(i), F.lit(0)))).otherwise(F.lit(0).cast("long"))
        left = F.filter(F.transform(queue, lambda q, i: entry(q["day"], q["amt"] - used(q, i))), lambda q: q["amt"] > 0)
        ready = F.aggregate(F.filter(queue, ripe), F.lit(0).cast("long"), lambda s, q: s + q["amt"])
        older = F.aggregate(F.filter(queue, lambda q: ripe(q) & (q["day"] < e["day"])), F.lit(0).cast("long"), lambda s, q: s + q["amt"])
        today = F.least(e["in"], F.greatest(e["out"] - older, F.lit(0))) if min_lag == 0 else F.lit(0)
        return F.struct(left.alias("queue"), (a["matched"] + F.least(e["out"], ready)).cast("long").alias("matched"), (a["same_day"] + today).cast("long").alias("same_day"))

    return F.aggregate(days, start, step, lambda a: F.struct(a["matched"], a["same_day"]))


def totals(days: Column, side: str) -> Column:
    return F.aggregate(days, F.lit(0).cast("long"), lambda s, d: s + d[side])


def fifo(net: Network, window: int = 2, min_lag: int = 0, self_transfers: bool = False) -> DataFrame:
    """(gid, matched, same_day, total_in, total_out, in_fraction, out_fraction, active_days) of nodes with flow.

    min_lag 0 lets a day's inflow cover its outflow, 1 only later days'; fractions are 0 without a total.
    """
    rows = daily_flows(net, self_transfers).select("gid", fold(F.col("days"), window, min_lag).alias("m"), totals(F.col("days"), "in").alias("total_in"), totals(F.col("days"), "out").alias("total_out"), F.size("days").cast("long").alias("active_days"))
    part = lambda t: F.when(F.col(t) > 0, six(F.col("matched") / F.col(t))).otherwise(F.lit(0.0))
    rows = rows.select("gid", "m.matched", "m.same_day", "total_in", "total_out", "active_days")
    return rows.withColumn("in_fraction", part("total_in")).withColumn("out_fraction", part("total_out"))


def timing(net: Network, window: int = 2) -> DataFrame:
    """(gid, active_days, and matched sums and fractions with same-day cover and without) from one pass over the days."""
    rows = daily_flows(net).select("gid", F.size("days").cast("long").alias("active_days"), totals(F.col("days"), "in").alias("i"), totals(F.col("days"), "out").alias("o"), fold(F.col("days"), window, 0).alias("m"), fold(F.col("days"), window, 1).alias("s"))
    part = lambda m, t, name: F.when(F.col(t) > 0, six(F.col(f"{m}.matched") / F.col(t))).otherwise(F.lit(0.0)).alias(name)
    return rows.select("gid", "active_days", "m.matched", "m.same_day", F.col("s.matched").alias("strict_matched"), part("m", "i", "temporal_in"), part("m", "o", "temporal_out"), part("s", "i", "strict_in"), part("s", "o", "strict_out"))


def sweep(net: Network, windows: tuple[int, ...] = (0, 1, 2, 7)) -> DataFrame:
    """(window, matched, incoming) over the network, self-transfers included, from one pass over the days."""
    rows = daily_flows(net, self_transfers=True)
    made = rows.select(F.explode(F.array(*[F.struct(F.lit(w).alias("window"), fold(F.col("days"), w)["matched"].alias("matched"), totals(F.col("days"), "in").alias("incoming")) for w in windows])).alias("x"))
    return made.groupBy("x.window").agg(F.sum("x.matched").alias("matched"), F.sum("x.incoming").alias("incoming"))


def next_outgoing(net: Network, lags: tuple[int, ...] = (0, 1, 2, 7)) -> DataFrame:
    """(lag, n, cents): transfers to others whose receiver sends to others again within lag days; lag null: all.

    As-of by one sort: a node's days of inflow and of outflow stand in one order, latest first, and the last outflow day passed
    is carried along, so each day is read once.
    """
    tx = net.tx.where("src <> dst")
    inn = tx.groupBy(F.col("dst").alias("gid"), "day").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).withColumn("out", F.lit(None).cast("date"))
    none = F.lit(None).cast("long")
    out = tx.select(F.col("src").alias("gid"), "day").distinct().select("gid", "day", none.alias("n"), none.alias("cents"), F.col("day").alias("out"))
    latest_first = Window.partitionBy("gid").orderBy(F.desc("day"), F.asc_nulls_last("out")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = inn.unionByName(out).withColumn("next", F.last("out", ignorenulls=True).over(latest_first)).where("n is not null")
    near = near.select("n", "cents", F.datediff("next", "day").alias("lag"))
    within = [F.struct(F.lit(x).alias("lag"), (F.col("lag") <= x).alias("hit")) for x in lags] + [F.struct(F.lit(None).cast("int").alias("lag"), F.lit(True).alias("hit"))]
    rows = near.select("n", "cents", F.explode(F.array(*within)).alias("w")).where("w.hit")
    return rows.groupBy("w.lag").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def flow_pairs(net: Network, window: int = 2) -> DataFrame:
    """(gid, payer, payee, lag, in_cents, out_cents): what a node received and what it sent within window days.

    An equi-join on node and day: outflows are spread over the days they may answer, so that a busy node's
    whole history never meets itself.
    """
    tx = net.tx.where("src <> dst")
    inn = tx.select(F.col("dst").alias("gid"), F.col("src").alias("payer"), "day", F.col("cents").alias("in_cents"))
    out = tx.select(F.col("src").alias("gid"), F.col("dst").alias("payee"), F.col("cents").alias("out_cents"), F.explode(F.sequence(F.lit(0), F.lit(window))).alias("lag"), F.col("day").alias("sent"))
    out = out.withColumn("day", F.date_sub("sent", F.col("lag"))).drop("sent")
    return inn.join(out, ["gid", "day"]).select("gid", "payer", "payee", "lag", "in_cents", "out_cents")


def transit_definitions(net: Network) -> DataFrame:
    """What could make a node with in- and outflow a transit: (gid, reversed: all outflow before all inflow; any_after: some
    outflow on or after some inflow; and of the pairs 0 to 2 days apart: pairs, outflow covers 85 %, within 85-115 %,
    within 85-100 %, agrees to 85 %, agrees to 85 % with distinct ends)."""
    a, b = F.col("in_cents"), F.col("out_cents")
    alike = F.least(a, b) * 100 >= F.greatest(a, b) * 85
    close = flow_pairs(net).groupBy("gid").agg(
        F.count("*").alias("pairs"), F.bool_or(b * 100 >= a * 85).alias("covers_85"), F.bool_or((b * 100 >= a * 85) & (b * 100 <= a * 115)).alias("band_115"), F.bool_or((b * 100 >= a * 85) & (b <= a)).alias("band_100"),
        F.bool_or(alike).alias("symmetric"), F.bool_or(alike & (F.col("payer") != F.col("payee"))).alias("distinct_ends"),
    )
    # some pair is in order if the first inflow is no later than the last outflow
    days = both_ends(net.tx.where("src <> dst"), "day").groupBy("gid").agg(*[f(F.when(F.col("side") == s, F.col("day"))).alias(f"{s}_{n}") for s in ("in", "out") for n, f in (("first", F.min), ("last", F.max))]).where("in_first is not null and out_first is not null")
    flags = days.select("gid", (F.col("out_last") < F.col("in_first")).alias("reversed"), (F.col("out_last") >= F.col("in_first")).alias("any_after"))
    return flags.join(close, "gid", "left").na.fill(0, ["pairs"]).na.fill(False)


def pass_through_pairs(net: Network) -> DataFrame:
    """(gid, pairs, payers, payees): transfers that leave within two days at 85 % agreement or more, to someone else."""
    a, b = F.col("in_cents"), F.col("out_cents")
    hit = flow_pairs(net).where((F.least(a, b) * 100 >= F.greatest(a, b) * 85) & (F.col("payer") != F.col("payee")))
    return hit.groupBy("gid").agg(F.count("*").alias("pairs"), F.count_distinct("payer").alias("payers"), F.count_distinct("payee").alias("payees"))
