"""The registry: each query by name, as a DataFrame over the derived network and, where SQL can say it, as SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import centrality, communities, explore, fifo, flows, motifs, paths, roles, validate, verify
from flowlens.plans import oracle as o
from flowlens.plans.oracle import six, sql
from flowlens.plans.shared import cut
from flowlens.sources import sinks
from flowlens.sources.fixture import layout, made_from, network, raw_network, spoiled, table_path
from flowlens.sources.tables import Network, as_network, file_digests, read_raw
from flowlens.streaming import matching, monitor

Query = Callable[[SparkSession, str], DataFrame]
_KEPT: dict[tuple, DataFrame] = {}


def _kept(net: Network, spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """An intermediate that several queries share, written once for each session and folder."""
    key = (*made_from(spark, sf_dir), name)
    if key not in _KEPT:
        _KEPT[key] = cut(make(), name)
    return _KEPT[key]


def by_twelve(net: Network) -> DataFrame:
    """A clustering that both engines can state: ids in twelves."""
    return net.nodes.select("gid", F.floor(F.col("gid") / 12).alias("cluster_id"))


def _central(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact betweenness, which every clustering's features share."""
    net = network(spark, sf_dir)
    return _kept(net, spark, sf_dir, "central", lambda: centrality.betweenness(net))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return _kept(net, spark, sf_dir, "features", lambda: roles.features(net, by_twelve(net), central=_central(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return _kept(net, spark, sf_dir, "scored", lambda: roles.prioritise(roles.classify(_features(spark, sf_dir))))


def _plain(f: Callable[[Network, DataFrame], DataFrame]) -> Query:
    """For queries over sums and clusters of nodes alone, that need neither betweenness nor roles."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        net = network(spark, sf_dir)
        return f(net, net.nodes.join(flows.turnover(net), "gid").join(by_twelve(net), "gid"))

    return run


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the engine's own communities: features, roles and priorities."""
    net = network(spark, sf_dir)
    return _kept(net, spark, sf_dir, "full", lambda: roles.prioritise(roles.classify(roles.features(net, communities.communities(net), central=_central(spark, sf_dir)))))


def _run(f: Callable[[Network, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(network(spark, sf_dir), _full(spark, sf_dir))


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and priorities under the base, relaxed and strict rules."""
    net = network(spark, sf_dir)
    return _kept(net, spark, sf_dir, "scenarios", lambda: roles.scenarios(_features(spark, sf_dir)))


def _cases(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_scenarios(spark, sf_dir))


def _spoiled(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spoiled(spark, sf_dir))


def _tenth(c: str, k: int) -> Column:
    return F.col(c) % 10 == k


def spoiled_rows(rows: DataFrame) -> DataFrame:
    """Scored rows with faults that output checks count, placed by id."""
    more = rows.unionByName(rows.where(_tenth("gid", 4)))
    return more.withColumns({
        "role": F.when(_tenth("gid", 1), F.lit("boss")).otherwise(F.col("role")), "role_score": F.when(_tenth("gid", 2), F.lit(1.5)).when(_tenth("gid", 6) & F.col("truncated"), F.lit(0.9)).otherwise(F.col("role_score")),
        "priority_score": F.when(_tenth("gid", 3), F.lit(-1.0)).otherwise(F.col("priority_score")), "peripheral_reason": F.when(_tenth("gid", 5), F.lit("")).otherwise(F.col("peripheral_reason")),
    })


def _spoiled_outputs(n: Network, r: DataFrame) -> DataFrame:
    """Checks of outputs that were spoiled apart: rows by id, clusters and list by rules of their own."""
    third = lambda k: F.pmod("cluster_id", F.lit(3)) == k
    clusters = roles.cluster_summary(n, r).withColumns({"n_nodes": F.col("n_nodes") + third(1).cast("long"), "top_gids": F.when(third(0), F.array(F.lit(-1).cast("long"))).otherwise(F.col("top_gids"))})
    top = roles.top_nodes(r).withColumns({"priority_score": F.col("priority_score") + (F.col("rank") == 5).cast("double"), "rank": F.when(F.col("rank") <= 3, 1).otherwise(F.col("rank"))})
    return verify.check_outputs(spoiled_rows(r), clusters, top)


def _spoiled_figures(n: Network, r: DataFrame) -> DataFrame:
    """Checks against the inputs of rows and clusters with changed figures."""
    clusters = roles.cluster_summary(n, r).withColumn("internal_cents", F.col("internal_cents") + F.when((F.pmod("cluster_id", F.lit(3)) == 0) & (F.col("internal_cents") > 0), 1).otherwise(0))
    one = lambda c, k: F.col(c) + _tenth("gid", k).cast("long")
    rows = r.withColumns({"in_deg": one("in_deg", 1), "in_cents": one("in_cents", 2), "depth": (F.col("depth") + _tenth("gid", 3).cast("int")).cast("int"), "truncated": F.col("truncated") != _tenth("gid", 4)})
    return verify.check_against_inputs(n, rows, clusters)


def _spoiled_snapshot(n: Network, r: DataFrame) -> DataFrame:
    """Checks of a snapshot whose pairs and nodes were changed by id."""
    pair = lambda k: (F.col("src") + F.col("dst")) % 10 == k
    edges = n.edges.withColumn("cents", F.col("cents") + pair(1).cast("long"))
    return sinks.snapshot_faults({"edges": edges.unionByName(edges.where(pair(3))), "transactions": n.tx, "nodes": r.withColumn("in_cents", F.col("in_cents") + _tenth("gid", 2).cast("long"))})


def _offset(net: Network) -> Network:
    """The network with ids beyond what a double can hold."""
    return Network(net.nodes.withColumn("gid", F.col("gid") + (1 << 53)), net.edges, net.tx)


def _layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n, total) of the three tables, read in the layout of a data folder."""
    raw = read_raw(spark, layout(spark, sf_dir))
    of = lambda name, total: raw[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), total.cast("long").alias("total"))
    return of("nodes", F.sum("gid")).unionByName(of("edges", F.sum(F.rint(F.col("sum_kzt") * 100)))).unionByName(of("transactions", F.sum(F.rint(F.col("sum_kzt") * 100))))


def _metrics(net: Network) -> DataFrame:
    """(gid, rank, hub, authority, betweenness), rounded."""
    rank = centrality.pagerank(net).select("gid", flows.six(F.col("rank")).alias("rank"))
    return cut(rank.join(centrality.hits(net), "gid").join(centrality.betweenness(net), "gid"), "metrics")


def _net(f: Callable[[Network], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(network(spark, sf_dir))


def _rows(f: Callable[[Network, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(network(spark, sf_dir), _scored(spark, sf_dir))


def _raw(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(raw_network(spark, sf_dir))


def _texts(rows: DataFrame, column: str) -> DataFrame:
    """Array column as text, for engines that compare plain values."""
    return rows.withColumn(column, F.concat_ws("-", F.transform(column, lambda m: m.cast("string"))))


def _resolutions(net: Network, tried: tuple[float, ...] = (0.8, 1.2)) -> DataFrame:
    """(resolution, rand): how far communities agree with those at resolution 1."""
    with ThreadPoolExecutor(1 + len(tried)) as pool:  # independent searches, whose rounds of few tasks fill the cores together
        base, *others = pool.map(lambda g: cut(communities.communities(net, g), "base"), (1.0, *tried))
    made = None
    for g, other in zip(tried, others, strict=True):
        other = other.withColumnRenamed("cluster_id", "other")
        one = stats.adjusted_rand(base.join(other, "gid"), "cluster_id", "other").select(F.lit(g).alias("resolution"), "rand")
        made = one if made is None else made.unionByName(one)
    return made


def _network_queries() -> dict[str, tuple[Query, str | None]]:
    text = "array_to_string({}, '-')"
    fifo_cols = "gid, matched, same_day, total_in, total_out, in_fraction, out_fraction, active_days"
    degree = sql(f"SELECT * FROM deg", o.DEGREES)  # noqa: F541
    checks = ("nodes_null", "nodes_gid", "nodes_depth", "nodes_seed", "edges_null", "edges_depth", "edges_count", "edges_money", "tx_null", "tx_money", "tx_date", "tx_zones", "nodes_unique", "edges_unique", "ids_known")
    wedge = """SELECT count(*) AS wedges, sum((x.f <= y.l)::INT)::BIGINT AS in_time, sum((x.f < y.l)::INT)::BIGINT AS strictly, sum((s.src IS NOT NULL)::INT)::BIGINT AS closed FROM
      (SELECT src, dst, min(day) AS f FROM ed GROUP BY src, dst) x JOIN (SELECT src, dst, max(day) AS l FROM ed GROUP BY src, dst) y ON x.dst = y.src AND x.src <> y.dst LEFT JOIN links s ON s.src = x.src AND s.dst = y.dst"""
    pagerank = (
        "pt AS (SELECT src, sum(cents) AS t FROM edges GROUP BY src)",
        "pm AS (SELECT a.gid AS src, b.gid AS dst, 0.15 / m + 0.85 * CASE WHEN pt.t IS NULL THEN 1.0 / m ELSE coalesce(CAST(e.cents AS DOUBLE) / pt.t, 0) END AS w FROM nodes a CROSS JOIN nodes b CROSS JOIN (SELECT count(*) AS m FROM nodes) LEFT JOIN pt ON pt.src = a.gid LEFT JOIN edges e ON e.src = a.gid AND e.dst = b.gid)",
        "pg(gid, r, i) AS (SELECT gid, 1.0::DOUBLE / (SELECT count(*) FROM nodes), 0 FROM nodes UNION ALL SELECT pm.dst, sum(pg.r * pm.w), pg.i + 1 FROM pg JOIN pm ON pm.src = pg.gid WHERE pg.i < 230 GROUP BY pm.dst, pg.i + 1)",
    )
    hits = lambda w: (
        f"hw AS (SELECT src, dst, {w} AS w FROM edges)",
        "hm AS (SELECT x.src AS a, y.src AS b, sum(x.w * y.w) AS w FROM hw x JOIN hw y ON x.dst = y.dst GROUP BY x.src, y.src)",
        "hh(gid, h, i) AS (SELECT gid, 1.0::DOUBLE, 0 FROM nodes UNION ALL SELECT a, h / sum(h) OVER (), i FROM (SELECT hm.a, sum(hh.h * hm.w) AS h, hh.i + 1 AS i FROM hh JOIN hm ON hm.b = hh.gid WHERE hh.i < 600 GROUP BY hm.a, hh.i + 1))",
        "ha AS (SELECT hw.dst AS gid, sum(hh.h * hw.w) AS a FROM hh JOIN hw ON hw.src = hh.gid WHERE hh.i = 600 GROUP BY hw.dst)",
    )
    both_hits = f"SELECT gid, coalesce({six('hh.h / (SELECT sum(h) FROM hh WHERE i = 600)')}, 0) AS hub, coalesce({six('ha.a / (SELECT sum(a) FROM ha)')}, 0) AS authority FROM nodes LEFT JOIN (SELECT * FROM hh WHERE i = 600) hh USING (gid) LEFT JOIN ha USING (gid)"
    hop = "hop AS (SELECT row_number() OVER () AS id, members, length FROM cy), leg AS (SELECT id, members, length, members[i] AS src, members[i % length + 1] AS dst, i FROM hop, range(1, 7) t(i) WHERE i <= length)"
    first = "ftx AS (SELECT src, dst, min({'day': day, 'cents': cents}) AS t, count(*) AS n_tx FROM tx WHERE src <> dst GROUP BY src, dst)"
    desc = "dc AS (SELECT id, any_value(members) AS members, any_value(length) AS length, CASE WHEN max(t.cents) > 0 THEN round_even(min(t.cents) * 10000.0 / max(t.cents), 0) / 10000 ELSE 0 END AS agreement, max(t.day) - min(t.day) AS span_days, min(t.day) AS first_day, max(t.day) AS last_day FROM leg JOIN ftx USING (src, dst) GROUP BY id HAVING count(*) = any_value(length))"
    best = "bc AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY agreement DESC, span_days, length, list_transform(members, lambda m: CAST(m AS VARCHAR))) AS r FROM (SELECT *, unnest(members) AS gid FROM dc))"
    repeat = "rp AS (SELECT src, dst, cents, count(*) AS n FROM tx WHERE src <> dst GROUP BY src, dst, cents HAVING count(*) >= 3)"
    burst = "bu AS (SELECT gid, day, side, count(*) AS n FROM ends WHERE side = 'out' OR NOT own GROUP BY gid, day, side HAVING count(*) >= 5)"
    cyc6, cyc3 = (o.CYCLES.format(longest=k) for k in (6, 3))
    turn = (
        hop,
        "dl AS (SELECT id, length, i, list_sort(list(DISTINCT ed.day)) AS days FROM leg JOIN ed USING (src, dst) GROUP BY id, length, i)",
        "ro AS (SELECT h.id, h.length, r FROM hop h, range(1, 7) t(r) WHERE r <= h.length)",
        "gr(id, length, r, k, start, a, mode) AS (SELECT ro.id, ro.length, ro.r, 1, unnest(dl.days), unnest(dl.days), m.mode FROM ro JOIN dl ON dl.id = ro.id AND dl.i = ro.r CROSS JOIN (SELECT unnest([0, 1]) AS mode) m UNION ALL SELECT gr.id, gr.length, gr.r, gr.k + 1, gr.start, list_min(list_filter(dl.days, lambda d: d >= gr.a + gr.mode)), gr.mode FROM gr JOIN dl ON dl.id = gr.id AND dl.i = (gr.r - 1 + gr.k) % gr.length + 1 WHERE gr.k < gr.length AND gr.a IS NOT NULL)",
        "ok AS (SELECT id, any_value(length) AS length, bool_or(k = length AND mode = 0 AND a IS NOT NULL) AS o1, bool_or(k = length AND mode = 1 AND a IS NOT NULL) AS o2, bool_or(k = length AND mode = 0 AND a IS NOT NULL AND a - start <= 2) AS o3 FROM gr GROUP BY id)",
    )
    tr = o.EDGE_DAYS
    return {
        "validate_counts": (_spoiled(lambda r: validate.violations(**r)), sql("""SELECT * FROM (SELECT unnest(['nodes_null', 'nodes_gid', 'nodes_depth', 'nodes_seed']) AS "check", unnest([count(*) FILTER (depth IS NULL), count(*) FILTER (gid < 0), count(*) FILTER (depth NOT BETWEEN 0 AND 4), count(*) FILTER (is_seed <> (depth = 0))]) AS violations FROM bn)
          UNION ALL SELECT unnest(['edges_null', 'edges_depth', 'edges_count', 'edges_money']), unnest([count(*) FILTER (p = 5), count(*) FILTER (depth NOT BETWEEN 1 AND 4), count(*) FILTER (n_tx <= 0), count(*) FILTER (p = 2)]) FROM be
          UNION ALL SELECT unnest(['tx_null', 'tx_money', 'tx_date', 'tx_zones']), unnest([count(*) FILTER (p = 7), count(*) FILTER (p = 6), count(*) FILTER (p = 7), greatest(count(DISTINCT p = 9) FILTER (p <> 7) - 1, 0)]) FROM bt
          UNION ALL SELECT 'nodes_unique', count(*) FROM (SELECT gid FROM bn GROUP BY gid HAVING count(*) > 1) UNION ALL SELECT 'edges_unique', count(*) FROM (SELECT src, dst FROM be GROUP BY src, dst HAVING count(*) > 1)
          UNION ALL SELECT 'ids_known', count(*) FROM ((SELECT src AS g FROM be UNION SELECT dst FROM be UNION SELECT src FROM bt UNION SELECT dst FROM bt) EXCEPT SELECT gid FROM bn)""", *o.SPOILED)),
        "validate_clean": (_raw(lambda r: validate.violations(**r)), "SELECT unnest([" + ", ".join(f"'{c}'" for c in checks) + "]) AS \"check\", CAST(0 AS BIGINT) AS violations"),
        "load_network": (_layout_counts, sql("SELECT 'nodes' AS name, count(*) AS n, CAST(sum(gid) AS BIGINT) AS total FROM nodes UNION ALL SELECT 'edges', count(*), CAST(sum(cents) AS BIGINT) FROM edges UNION ALL SELECT 'transactions', count(*), CAST(sum(cents) AS BIGINT) FROM tx")),
        "reconcile_pairs": (_net(validate.reconcile), sql("""SELECT count(*) AS pairs, sum((e.src IS NULL)::INT)::BIGINT AS only_tx, sum((t.src IS NULL)::INT)::BIGINT AS only_edges, coalesce(sum((e.cents <> t.c)::INT), 0)::BIGINT AS cents_differ, coalesce(sum((e.n_tx <> t.n)::INT), 0)::BIGINT AS counts_differ
          FROM edges e FULL JOIN (SELECT src, dst, sum(cents) AS c, count(*) AS n FROM tx GROUP BY src, dst) t ON e.src = t.src AND e.dst = t.dst""")),
        "weak_reconcile": (_spoiled(lambda r: validate.weak_reconcile(as_network(**r))), sql("SELECT lacks, count(*) AS count FROM (SELECT 'tx' AS lacks, src, dst FROM be x WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.src = x.src AND bt.dst = x.dst) UNION ALL SELECT DISTINCT 'edges', src, dst FROM bt WHERE NOT EXISTS (SELECT 1 FROM be WHERE bt.src = be.src AND bt.dst = be.dst)) GROUP BY lacks", *o.SPOILED)),
        "data_warnings": (_net(validate.warnings), sql("SELECT bool_or(cents < 500000) AS below_5000, count(DISTINCT date_trunc('month', day)) > 1 AS several_months, bool_or(src = dst) AS self_transfers FROM tx")),
        "network_nodes": (_net(lambda n: n.nodes), sql("SELECT * FROM nodes")),
        "network_edges": (_net(lambda n: n.edges), sql("SELECT * FROM edges")),
        "node_degrees": (_net(flows.degrees), degree),
        "node_flows": (_net(flows.flows), sql("SELECT * FROM fl", o.FLOWS)),
        "active_days": (_net(flows.active_days), sql("SELECT * FROM ad", o.ENDS, o.ACTIVE)),
        "truncation_flags": (_net(flows.truncated), sql("SELECT * FROM tr", o.DEGREES, o.TRUNCATED)),
        "orphans": (_net(flows.orphans), sql("SELECT gid, is_seed FROM nodes WHERE gid NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")),
        "edge_directions": (_net(flows.edge_directions), sql("SELECT sum((b.depth < a.depth)::INT)::BIGINT AS backward, sum((b.depth = a.depth)::INT)::BIGINT AS same_depth, sum((b.is_seed AND a.depth > 0)::INT)::BIGINT AS to_seeds FROM edges JOIN nodes a ON a.gid = src JOIN nodes b ON b.gid = dst")),
        "exact_ids": (_net(lambda n: flows.exact_ids(_offset(n))), sql("SELECT count(*) FILTER (CAST(CAST(gid + 9007199254740992 AS DOUBLE) AS BIGINT) <> gid + 9007199254740992) AS altered FROM nodes")),
        "cent_residuals": (_spoiled(lambda r: flows.cent_residuals(r["edges"].where("sum_kzt is not null"))), sql("SELECT count(*) FILTER (p = 2) AS n_off, max(CASE WHEN p = 2 THEN 0.4 ELSE 0 END)::DOUBLE AS max_off FROM be WHERE p <> 5", *o.SPOILED)),
        "starter_ratio": (_net(flows.starter_ratio), sql(f"SELECT gid, CASE WHEN in_cents > 0 THEN {six('CAST(out_cents AS DOUBLE) / in_cents')} END AS pass_through FROM fl", o.FLOWS)),
        "boundary_medians": (_net(flows.boundary_medians), sql("SELECT CASE WHEN truncated THEN 'boundary' ELSE 'interior' END AS place, count(*) AS n, median(in_cents)::DOUBLE AS in_cents, median(in_tx)::DOUBLE AS in_tx FROM fl JOIN nodes USING (gid) JOIN deg USING (gid) JOIN tr USING (gid) WHERE NOT is_seed AND out_deg = 0 AND ext_in_cents > 0 GROUP BY 1", o.DEGREES, o.FLOWS, o.TRUNCATED)),
        "inbound_profile": (_net(flows.inbound_profile), sql("SELECT dst AS gid, count(*) AS n_tx, count(DISTINCT src) AS payers, CAST(sum(cents) AS BIGINT) AS cents, max(cents) AS largest, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day FROM tx WHERE src <> dst GROUP BY dst")),
        "activity_span": (_net(flows.activity_span), sql("SELECT gid, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day FROM ends GROUP BY gid", o.ENDS)),
        "run_summary": (_net(lambda n: flows.run_summary(n, paths.components(n))), sql("""SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM seeds) AS n_seeds, (SELECT count(*) FROM edges) AS n_edges, count(*) AS n_tx, CAST(sum(cents) AS BIGINT) AS turnover_cents, min(day) AS first_day, max(day) AS last_day,
          (SELECT count(*) FROM nodes WHERE gid NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_isolates, (SELECT count(*) FROM tr WHERE truncated) AS n_truncated, (SELECT count(DISTINCT component_id) FROM cmp) AS n_components FROM tx""", o.DEGREES, o.TRUNCATED, o.ALL_COMPONENTS)),
        "amount_quantiles": (_net(lambda n: flows.quantiles(n.tx, "cents")), sql(f"SELECT p, {six('quantile_cont_value')} AS value FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]::DOUBLE[]) AS p, unnest(quantile_cont(cents::DOUBLE, [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])) AS quantile_cont_value FROM tx)")),
        "top_edge_share": (_net(flows.top_edge_share), sql(f"SELECT CAST(t AS BIGINT) AS top_cents, CAST(a AS BIGINT) AS all_cents, {six('CAST(t AS DOUBLE) / a')} AS share FROM (SELECT sum(cents) AS t FROM (SELECT cents FROM edges ORDER BY cents DESC, src, dst LIMIT 50)), (SELECT sum(cents) AS a FROM edges)")),
        "duplicates": (_net(flows.duplicates), sql("SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(c - 1) AS BIGINT) AS repeats FROM (SELECT count(*) AS c FROM tx GROUP BY src, dst, day, cents)")),
        "edge_day_stats": (_net(flows.edge_day_stats), sql("SELECT sum((c = 1)::INT)::BIGINT AS single_tx, sum((d = 1)::INT)::BIGINT AS single_day, max(d) AS most_days FROM (SELECT count(*) AS c, count(DISTINCT day) AS d FROM tx GROUP BY src, dst)")),
        "depth_histogram": (_net(flows.depth_histogram), sql("SELECT depth, count(*) AS n, 'nodes' AS kind FROM nodes GROUP BY depth UNION ALL SELECT depth, count(*), 'edges' FROM edges GROUP BY depth")),
        "daily_fanout": (_net(flows.daily_fanout), sql("SELECT gid, day, recipients, n_tx, cents, rank FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY recipients DESC, cents DESC, day) AS rank FROM (SELECT src AS gid, day, count(DISTINCT dst) AS recipients, count(*) AS n_tx, CAST(sum(cents) AS BIGINT) AS cents FROM tx WHERE src <> dst GROUP BY src, day)) WHERE rank <= 3")),
        "paid_once": (_net(flows.paid_once), sql("SELECT src AS gid, count(*) AS recipients, sum((c = 1)::INT)::BIGINT AS paid_once FROM (SELECT src, dst, count(*) AS c FROM tx WHERE src <> dst GROUP BY src, dst) GROUP BY src")),
        "net_balance": (_net(flows.net_balance), sql("SELECT CAST(sum(greatest(ext_in_cents - ext_out_cents, 0)) AS BIGINT) AS kept_all, CAST(sum(CASE WHEN NOT is_seed AND NOT truncated THEN greatest(ext_in_cents - ext_out_cents, 0) ELSE 0 END) AS BIGINT) AS kept_observed FROM fl JOIN nodes USING (gid) JOIN tr USING (gid)", o.DEGREES, o.FLOWS, o.TRUNCATED)),
        "ratio_candidates": (_net(flows.ratio_candidates), sql("SELECT gid, pass_through FROM fl JOIN nodes USING (gid) JOIN tr USING (gid) WHERE NOT is_seed AND NOT truncated AND ext_in_cents > 0 AND ext_out_cents > 0 AND pass_through BETWEEN 0.8 AND 1.2", o.DEGREES, o.FLOWS, o.TRUNCATED)),
        "calendar": (_net(flows.calendar), sql("SELECT CAST(dayofweek(day) + 1 AS INTEGER) AS weekday, count(*) AS n_tx, count(DISTINCT day) AS days FROM tx GROUP BY 1")),
        "export_ordinals": (_net(flows.export_ordinals), sql("SELECT row_number() OVER (ORDER BY day, src, dst, cents) - 1 AS row_id, src, dst, day, cents FROM tx")),
        "fifo_same_day": (_net(lambda n: fifo.fifo(n, 2, 0)), sql(f"SELECT {fifo_cols} FROM f0", o.ENDS, *o.fifo("f0", 2, 0))),
        "fifo_strict": (_net(lambda n: fifo.fifo(n, 2, 1)), sql(f"SELECT {fifo_cols} FROM f1", o.ENDS, *o.fifo("f1", 2, 1))),
        "fifo_legacy": (_net(lambda n: fifo.fifo(n, 2).select("gid", "in_fraction", "active_days")), sql("SELECT gid, in_fraction, active_days FROM f0", o.ENDS, *o.fifo("f0", 2, 0))),
        "fifo_lag": (_net(lambda n: fifo.fifo(n, 7, 2)), sql(f"SELECT {fifo_cols} FROM f2", o.ENDS, *o.fifo("f2", 7, 2))),
        "fifo_skip": (_net(lambda n: fifo.fifo(n, 3, 1)), sql(f"SELECT {fifo_cols} FROM f3", o.ENDS, *o.fifo("f3", 3, 1))),
        "fifo_sweep": (_net(fifo.sweep), sql(" UNION ALL ".join(f'SELECT {w} AS "window", CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(total_in) AS BIGINT) AS incoming FROM s{w}' for w in (0, 1, 2, 7)), o.ENDS, *[x for w in (0, 1, 2, 7) for x in o.fifo(f"s{w}", w, 0, True)])),
        "next_outgoing_lag": (_net(fifo.next_outgoing), sql("SELECT l.lag, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT i.cents, (SELECT min(q.day) FROM tx q WHERE q.src = i.dst AND q.src <> q.dst AND q.day >= i.day) - i.day AS lag FROM tx i WHERE i.src <> i.dst) x JOIN (SELECT unnest([0, 1, 2, 7, NULL]) AS lag) l ON l.lag IS NULL OR x.lag <= l.lag GROUP BY l.lag")),
        "transit_pairs": (_net(fifo.transit_definitions), sql("""SELECT gid, ol < i0 AS reversed, ol >= i0 AS any_after, coalesce(pairs, 0) AS pairs, coalesce(covers_85, false) AS covers_85, coalesce(band_115, false) AS band_115, coalesce(band_100, false) AS band_100, coalesce(z.agrees, false) AS "symmetric", coalesce(distinct_ends, false) AS distinct_ends
          FROM (SELECT dst AS gid, min(day) AS i0 FROM tx WHERE src <> dst GROUP BY dst) JOIN (SELECT src AS gid, max(day) AS ol FROM tx WHERE src <> dst GROUP BY src) USING (gid) LEFT JOIN
          (SELECT gid, count(*) AS pairs, bool_or(b * 100 >= a * 85) AS covers_85, bool_or(b * 100 >= a * 85 AND b * 100 <= a * 115) AS band_115, bool_or(b * 100 >= a * 85 AND b <= a) AS band_100, bool_or(least(a, b) * 100 >= greatest(a, b) * 85) AS agrees, bool_or(least(a, b) * 100 >= greatest(a, b) * 85 AND payer <> payee) AS distinct_ends FROM fp GROUP BY gid) z USING (gid)""", o.PAIRS)),
        "pass_through_pairs": (_net(fifo.pass_through_pairs), sql("SELECT gid, count(*) AS pairs, count(DISTINCT payer) AS payers, count(DISTINCT payee) AS payees FROM fp WHERE least(a, b) * 100 >= greatest(a, b) * 85 AND payer <> payee GROUP BY gid", o.PAIRS)),
        "seed_reach": (_net(paths.seed_reach), sql("SELECT * FROM sr", o.REACH, o.SEED_REACH)),
        "components": (_net(paths.components), sql("SELECT * FROM cmp", o.ALL_COMPONENTS)),
        "projection_components": (_net(paths.projection_components), sql("SELECT * FROM cmp", o.MONEY_COMPONENTS)),
        "component_profile": (_net(lambda n: paths.component_profile(n, paths.components(n))), sql("""SELECT component_id, n_nodes, n_seeds, leader, leader_payees, coalesce(n_edges, 0) AS n_edges, coalesce(t, 0) AS n_tx, coalesce(c, 0) AS cents FROM
          (SELECT component_id, count(*) AS n_nodes, sum(is_seed::INT)::BIGINT AS n_seeds, arg_min(gid, {'x': -out_deg, 'g': gid}) AS leader, max(out_deg) AS leader_payees FROM cmp JOIN nodes USING (gid) JOIN deg USING (gid) GROUP BY component_id)
          LEFT JOIN (SELECT component_id, count(*) AS n_edges, CAST(sum(n_tx) AS BIGINT) AS t, CAST(sum(cents) AS BIGINT) AS c FROM edges JOIN cmp ON gid = src GROUP BY component_id) USING (component_id)""", o.ALL_COMPONENTS, o.DEGREES)),
        "common_recipients": (_net(lambda n: paths.common_recipients(n, n.nodes.where("is_seed"))), sql("SELECT dst AS gid, count(DISTINCT src) AS n_payers, CAST(sum(cents) AS BIGINT) AS cents, min(day) AS first_day, max(day) AS last_day FROM tx WHERE src <> dst AND src IN (SELECT seed FROM seeds) GROUP BY dst HAVING count(DISTINCT src) >= 2")),
        "resilience": (_net(lambda n: paths.resilience(n, n.nodes.where("is_seed and gid % 3 = 0"))), sql("""SELECT removed, count(DISTINCT r) AS n_components, max(n) AS largest, any_value(coalesce(lone.c, 0)) AS cut_off FROM (SELECT removed, r, count(*) AS n FROM rt GROUP BY removed, r) LEFT JOIN (SELECT o AS removed, count(*) AS c FROM (SELECT a, min(b) AS o FROM und GROUP BY a HAVING count(DISTINCT b) = 1) GROUP BY o) lone USING (removed) GROUP BY removed""",
          "und AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links)", "gone AS (SELECT gid AS removed FROM nodes WHERE is_seed AND gid % 3 = 0)",
          "cl(removed, gid, r) AS (SELECT removed, gid, gid FROM nodes, gone WHERE gid <> removed UNION SELECT cl.removed, und.b, cl.r FROM cl JOIN und ON und.a = cl.gid WHERE cl.r < und.b AND und.b <> cl.removed)", "rt AS (SELECT removed, gid, min(r) AS r FROM cl GROUP BY removed, gid)")),
        "scc": (_net(paths.strong_components), sql("SELECT a AS gid, min(b) AS scc_id FROM (SELECT x.a, x.b FROM tc x JOIN tc y ON y.a = x.b AND y.b = x.a) GROUP BY a HAVING count(*) > 1", "tc(a, b) AS (SELECT src, dst FROM links UNION SELECT tc.a, links.dst FROM tc JOIN links ON links.src = tc.b)")),
        "reciprocal_pairs": (_net(paths.reciprocal), sql("SELECT x.src AS a, x.dst AS b, x.cents AS ab_cents, y.cents AS ba_cents FROM links x JOIN links y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")),
        "self_loops": (_net(lambda n: n.edges.where("src = dst").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))), sql("SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM edges WHERE src = dst")),
        "edge_days": (_net(lambda n: paths.edge_days(n).select("src", "dst", F.size("days").cast("long").alias("days"), F.date_from_unix_date(F.array_min("days")).alias("first_day"))), sql("SELECT src, dst, count(*) AS days, min(day) AS first_day FROM ed GROUP BY src, dst", tr)),
        "wedges": (_net(paths.wedges), sql(wedge, tr)),
        "triangles": (_net(lambda n: _texts(paths.cycles(n, 3).where("length = 3"), "members").select("members")), sql(f"SELECT {text.format('members')} AS members FROM cy WHERE length = 3", cyc3)),
        "cycles": (_net(lambda n: _texts(paths.cycles(n), "members")), sql(f"SELECT {text.format('members')} AS members, length FROM cy", cyc6)),
        "cycle_stats": (_net(lambda n: paths.cycle_stats(paths.cycles(n))), sql("SELECT length, count(*) AS n, count(DISTINCT members[1]) AS roots FROM cy GROUP BY length", cyc6)),
        "dated_cycles": (_net(paths.dated_cycles), sql("SELECT length, count(*) AS n, sum(o1::INT)::BIGINT AS in_order, sum(o2::INT)::BIGINT AS strictly, sum(o3::INT)::BIGINT AS in_window FROM ok GROUP BY length", tr, cyc6, *turn)),
        "temporal_reach": (_net(paths.temporal_reach), sql("SELECT * FROM tp", tr, o.temporal("tp", ">="))),
        "temporal_reach_strict": (_net(lambda n: paths.temporal_reach(n, strict=True)), sql("SELECT * FROM tp", tr, o.temporal("tp", ">"))),
        "state_reach": (_net(paths.state_reach), sql("SELECT seed, node FROM tp", tr, o.temporal("tp", ">="))),
        "incompatible_pairs": (_net(paths.incompatible_pairs), sql("SELECT seed, node FROM reach EXCEPT SELECT seed, node FROM tp", o.REACH, tr, o.temporal("tp", ">="))),
        "first_impossible": (_net(lambda n: _texts(paths.first_impossible(n), "path")), sql(f"""SELECT seed, node, {text.format('path')} AS path, CAST(CASE WHEN a1 IS NULL THEN 1 WHEN a2 IS NULL THEN 2 WHEN a3 IS NULL THEN 3 ELSE 4 END AS INTEGER) AS edge FROM (
          SELECT *, (SELECT min(day) FROM ed WHERE src = path[4] AND dst = path[5] AND day >= a3) AS a4 FROM (SELECT *, (SELECT min(day) FROM ed WHERE src = path[3] AND dst = path[4] AND day >= a2) AS a3 FROM (SELECT *, (SELECT min(day) FROM ed WHERE src = path[2] AND dst = path[3] AND day >= a1) AS a2 FROM (
          SELECT seed, node, path, (SELECT min(day) FROM ed WHERE src = path[1] AND dst = path[2]) AS a1 FROM wit JOIN (SELECT seed, node FROM reach EXCEPT SELECT seed, node FROM tp) USING (seed, node)))))""",
          o.REACH, tr, o.temporal("tp", ">="), "sp(seed, node, path) AS (SELECT seed, seed, [seed] FROM seeds UNION SELECT sp.seed, links.dst, list_append(sp.path, links.dst) FROM sp JOIN links ON links.src = sp.node WHERE len(sp.path) < 5 AND NOT list_contains(sp.path, links.dst))",
          "wit AS (SELECT seed, node, min(path) AS path FROM sp JOIN (SELECT seed, node, min(len(path)) AS m FROM sp GROUP BY seed, node) USING (seed, node) WHERE len(path) = m AND seed <> node GROUP BY seed, node)")),
        "ego_network": (_net(lambda n: paths.ego_network(n, 3)), sql("SELECT src, dst, cents FROM edges WHERE src IN (SELECT g FROM nb) AND dst IN (SELECT g FROM nb)", "nb AS (SELECT gid AS g FROM nodes WHERE gid = 3 UNION SELECT dst FROM links WHERE src = 3 UNION SELECT src FROM links WHERE dst = 3)")),
        "shortest_witness": (_net(lambda n: _texts(paths.shortest_witness(n), "path")), sql(f"SELECT seed, node, {text.format('min(path)')} AS path FROM sp JOIN (SELECT seed, node, min(len(path)) AS m FROM sp GROUP BY seed, node) USING (seed, node) WHERE len(path) = m AND seed <> node GROUP BY seed, node", "sp(seed, node, path) AS (SELECT seed, seed, [seed] FROM seeds UNION SELECT sp.seed, links.dst, list_append(sp.path, links.dst) FROM sp JOIN links ON links.src = sp.node WHERE len(sp.path) < 5 AND NOT list_contains(sp.path, links.dst))")),
        "simple_paths": (_net(paths.simple_paths), sql("SELECT seed, node, CAST(len(path) - 1 AS INTEGER) AS hops, count(*) AS n FROM sp WHERE len(path) > 1 GROUP BY ALL", "sp(seed, node, path) AS (SELECT seed, seed, [seed] FROM seeds UNION ALL SELECT sp.seed, links.dst, list_append(sp.path, links.dst) FROM sp JOIN links ON links.src = sp.node WHERE len(sp.path) < 5 AND NOT list_contains(sp.path, links.dst))")),
        "betweenness": (_net(centrality.betweenness), sql("SELECT gid, betweenness FROM bt", o.SIGMA)),
        "betweenness_by_joins": (_net(lambda n: centrality.betweenness(n, small_links=0)), sql("SELECT gid, betweenness FROM bt", o.SIGMA)),
        "betweenness_sampled": (_net(lambda n: centrality.betweenness(n, 64)), sql("SELECT gid, betweenness FROM bt", o.sampled_sigma(64))),
        "betweenness_within": (_net(centrality.betweenness_within), None),
        "pagerank": (_net(lambda n: centrality.pagerank(n).select("gid", flows.nine(F.col("rank")).alias("rank"))), sql("SELECT gid, round_even(r * 1e9, 0) / 1e9 AS rank FROM pg WHERE i = 230", *pagerank)),
        "hits": (_net(centrality.hits), sql(both_hits, *hits("1.0::DOUBLE"))),
        "hits_weighted": (_net(lambda n: centrality.hits(n, weighted=True)), sql(both_hits, *hits("cents::DOUBLE / (SELECT max(cents) FROM edges)"))),
        "centrality_overlap": (_net(lambda n: stats.top_matrix(_metrics(n), "gid", ("rank", "hub", "authority", "betweenness"), 50)), sql(f"SELECT x.m AS a, y.m AS b, count(*) AS shared FROM tt x JOIN tt y USING (gid) GROUP BY x.m, y.m", o.SIGMA, *pagerank, *hits("1.0::DOUBLE"), f"hb AS ({both_hits})",  # noqa: F541
          "tt AS (SELECT gid, m FROM (SELECT gid, m, row_number() OVER (PARTITION BY m ORDER BY v DESC, gid) AS r FROM (SELECT gid, 'hub' AS m, hub AS v FROM hb UNION ALL SELECT gid, 'authority', authority FROM hb UNION ALL SELECT gid, 'betweenness', betweenness FROM bt UNION ALL SELECT gid, 'rank', round_even(r * 1e6, 0) / 1e6 FROM pg WHERE i = 230)) WHERE r <= 50)")),
        "communities": (_net(communities.communities), None),
        "community_modularity": (_net(lambda n: communities.modularity(n, communities.communities(n))), None),
        "resolution_sweep": (_net(_resolutions), None),
        "other_clusters": (_net(lambda n: roles.other_clusters(n, by_twelve(n))), sql("SELECT * FROM oc", o.CLUSTER, o.OTHERS)),
        "cycle_motif": (_net(lambda n: _texts(motifs.best_cycles(n), "members").select("gid", "members", "length", "agreement", "span_days", "first_day", "last_day")), sql(f"SELECT gid, {text.format('members')} AS members, length, agreement, span_days, first_day, last_day FROM bc WHERE r = 1", cyc6, hop, first, desc, best)),
        "repeated_amounts": (_net(motifs.repeated_amounts), sql("SELECT * FROM rp", repeat)),
        "bursts": (_net(motifs.bursts), sql("SELECT * FROM bu", o.ENDS, burst)),
        "motif_best": (_net(lambda n: motifs.detect(n).select("gid", F.concat_ws(",", "motifs").alias("motifs"), "leading", F.col("repeat.n").alias("repeat_n"), F.col("repeat.cents").alias("repeat_cents"), F.col("burst.n").alias("burst_n"), F.col("cycle.length").alias("cycle_length"))), sql("""SELECT gid, concat_ws(',', CASE WHEN b.n IS NOT NULL THEN 'burst' END, CASE WHEN c.length IS NOT NULL THEN 'cycle' END, CASE WHEN r.n IS NOT NULL THEN 'repeat_amount' END) AS motifs, CASE WHEN c.length IS NOT NULL THEN 'cycle' WHEN b.n IS NOT NULL THEN 'burst' ELSE 'repeat_amount' END AS leading,
          r.n AS repeat_n, r.cents AS repeat_cents, b.n AS burst_n, c.length AS cycle_length FROM (SELECT gid FROM bc UNION SELECT src FROM rp UNION SELECT dst FROM rp UNION SELECT gid FROM bu) LEFT JOIN (SELECT gid, length FROM bc WHERE r = 1) c USING (gid)
          LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n DESC, cents DESC, CAST(src AS VARCHAR), CAST(dst AS VARCHAR)) AS k FROM (SELECT src AS gid, * FROM rp UNION ALL SELECT dst, * FROM rp)) WHERE k = 1) r USING (gid) LEFT JOIN (SELECT gid, max(n) AS n FROM bu GROUP BY gid) b USING (gid)""", o.ENDS, cyc6, hop, first, desc, best, repeat, burst)),
        "motif_summary": (_net(lambda n: motifs.detect(n).select("gid", "leading", "summary")), sql("""SELECT gid, CASE WHEN c.length IS NOT NULL THEN 'cycle' WHEN b.n IS NOT NULL THEN 'burst' ELSE 'repeat_amount' END AS leading,
          CASE WHEN c.length IS NOT NULL THEN 'money came back through ' || c.length || ' nodes within ' || c.span_days || ' days' WHEN b.n IS NOT NULL THEN b.n || ' transfers on ' || b.day ELSE r.n || ' transfers of exactly ' || format('{:.2f}', r.cents / 100.0::DOUBLE) || ' to one partner' END AS summary
          FROM (SELECT gid FROM bc UNION SELECT src FROM rp UNION SELECT dst FROM rp UNION SELECT gid FROM bu) LEFT JOIN (SELECT gid, length, span_days FROM bc WHERE r = 1) c USING (gid)
          LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n DESC, cents DESC, CAST(src AS VARCHAR), CAST(dst AS VARCHAR)) AS k FROM (SELECT src AS gid, * FROM rp UNION ALL SELECT dst, * FROM rp)) WHERE k = 1) r USING (gid)
          LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n DESC, day, side) AS k FROM bu) WHERE k = 1) b USING (gid)""", o.ENDS, cyc6, hop, first, desc, best, repeat, burst)),
    }


def _role_queries() -> dict[str, tuple[Query, str | None]]:
    priority, scored = o.PRIORITY, o.ROLES
    weighed = roles.weight_cases()
    reason = "CASE WHEN role <> 'peripheral' THEN '' WHEN in_deg + out_deg = 0 THEN 'isolated' WHEN truncated THEN 'truncated' WHEN is_seed THEN 'incomplete_seed' WHEN ext_in_cents = 0 THEN 'no_observed_input' ELSE 'no_rule' END"
    dominant = "(SELECT cluster_id, role AS dominant_role, n AS dominant_n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) AS k FROM (SELECT cluster_id, role, count(*) AS n, min(gid) AS f FROM pr GROUP BY cluster_id, role)) WHERE k = 1)"
    ranks = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    reasons = "list_slice(list_transform(list_sort([{'x': -x_bridge, 'p': 'bridge'}, {'x': -x_fan, 'p': 'fan'}, {'x': -x_flow, 'p': 'flow'}, {'x': -x_role_support, 'p': 'role_support'}, {'x': -x_seed_reach, 'p': 'seed_reach'}]), lambda s: s.p), 1, 2)"
    seedish = lambda rows: rows.select("in_tx", "is_seed", "gid", "in_deg", "out_deg", "cluster_id")
    checks = lambda n, r: r.agg(
        F.sum((~F.col("role").isin(*roles.ROLES, "peripheral")).cast("long")).alias("bad_role"), F.sum((~F.col("role_score").between(0, 1)).cast("long")).alias("bad_score"), F.sum((~F.col("priority_score").between(0, 1)).cast("long")).alias("bad_priority"),
        (F.count("*") - F.count_distinct("gid")).alias("repeated"), F.sum(((F.col("role") == "peripheral") == (F.col("peripheral_reason") == "")).cast("long")).alias("bad_reason"),
    )
    return {
        "node_features": (_rows(lambda n, r: r.select("gid", "in_deg", "out_deg", "seed_reach", "other_clusters", "betweenness", "active_days", "matched", "same_day", "strict_matched")), sql("SELECT ft.gid, in_deg, out_deg, seed_reach, other_clusters, betweenness, ft.active_days, coalesce(a.matched, 0) AS matched, coalesce(a.same_day, 0) AS same_day, coalesce(b.matched, 0) AS strict_matched FROM ft LEFT JOIN f0 a USING (gid) LEFT JOIN f1 b USING (gid)", *scored)),
        "roles": (_rows(lambda n, r: r.select("gid", "role", "role_score", F.concat_ws(",", "matched_roles").alias("matched_roles"))), sql("SELECT gid, role, role_score, concat_ws(',', CASE WHEN c1 THEN 'coordinator' END, CASE WHEN c2 THEN 'distributor' END, CASE WHEN c3 THEN 'consolidator' END, CASE WHEN c4 THEN 'transit' END, CASE WHEN c5 THEN 'terminal' END) AS matched_roles FROM sc", *scored)),
        "role_counts": (_rows(lambda n, r: r.groupBy("role").agg(F.count("*").alias("n"))), sql("SELECT role, count(*) AS n FROM rl GROUP BY role", *scored[:-2])),
        "role_evidence": (_rows(lambda n, r: roles.evidence(r).select("gid", "role", "evidence")), sql(f"""SELECT gid, role, left('Hypothesis: ' || CASE role WHEN 'coordinator' THEN 'lies between others (' || format('{{:.6f}}', betweenness) || '); ' || other_clusters || ' other clusters; reached by ' || seed_reach || ' seeds'
          WHEN 'distributor' THEN 'pays ' || out_deg || ' others in ' || out_tx || ' transfers, paid by ' || in_deg WHEN 'consolidator' THEN 'paid by ' || in_deg || ' others in ' || in_tx || ' transfers; reached by ' || seed_reach || ' seeds'
          WHEN 'transit' THEN 'passes on ' || format('{{:.6f}}', pass_through) || ' of its inflow' WHEN 'terminal' THEN 'received ' || format('{{:.2f}}', in_cents / 100.0::DOUBLE) || ' from ' || in_deg || ' others, sent nothing'
          ELSE in_deg || ' incoming and ' || out_deg || ' outgoing partners; ' || {reason} END || '. ' || CASE WHEN truncated THEN 'payments beyond the last depth are unknown' WHEN is_seed THEN 'a seed''s inflow is incomplete' ELSE 'the full balance is unknown' END || '.', 200) AS evidence FROM rl""", *scored[:-2])),
        "peripheral_reasons": (_rows(lambda n, r: r.select("gid", "peripheral_reason")), sql(f"SELECT gid, {reason} AS peripheral_reason FROM rl", *scored[:-2])),
        "priority": (_rows(lambda n, r: r.select("gid", "priority_score")), sql("SELECT gid, priority_score FROM pr", *priority)),
        "top_nodes": (_rows(lambda n, r: roles.top_nodes(r).drop("why")), sql(f"SELECT rank, gid, role, priority_score, array_to_string({reasons}, ',') AS reasons FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, gid) AS rank FROM pr) WHERE rank <= greatest(20, least(50, (SELECT count(*) FROM nodes)))", *priority)),
        "cluster_summary": (_rows(lambda n, r: _texts(roles.cluster_summary(n, r), "top_gids")), sql("""SELECT cluster_id, n_nodes, n_seed, coalesce(c, 0) AS internal_cents, array_to_string(tops, '-') AS top_gids, dominant_role, dominant_n FROM
          (SELECT cluster_id, count(*) AS n_nodes, sum(is_seed::INT)::BIGINT AS n_seed, list_slice(list(gid ORDER BY priority_score DESC, gid), 1, 5) AS tops FROM pr GROUP BY cluster_id)
          LEFT JOIN (SELECT a.cluster_id, CAST(sum(cents) AS BIGINT) AS c FROM edges JOIN cu a ON a.gid = src JOIN cu b ON b.gid = dst WHERE a.cluster_id = b.cluster_id GROUP BY a.cluster_id) USING (cluster_id)
          JOIN (SELECT cluster_id, role AS dominant_role, n AS dominant_n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) AS k FROM (SELECT cluster_id, role, count(*) AS n, min(gid) AS f FROM pr GROUP BY cluster_id, role)) WHERE k = 1) USING (cluster_id)""", *priority)),
        "cluster_hypotheses": (_rows(lambda n, r: roles.hypotheses(roles.cluster_summary(n, r))), sql(f"SELECT cluster_id, 'Hypothesis: a group of ' || count(*) || ' nodes, ' || any_value(dominant_n) || ' of them ' || any_value(dominant_role) || ', with ' || sum(is_seed::INT)::BIGINT || ' seeds.' AS hypothesis FROM pr JOIN {dominant} USING (cluster_id) GROUP BY cluster_id", *priority)),
        "weight_scenarios": (_rows(lambda n, r: roles.weight_scenarios(r)), sql(" UNION ALL ".join(f"SELECT '{name}' AS scenario, gid, priority_score FROM pr_w{k}" for k, name in enumerate(weighed)), *o.ROLES, o.ACTIVE_SHARES, *[o.scored(f"_w{k}", w, "") for k, w in enumerate(weighed.values())])),
        "selection_profile": (_rows(lambda n, r: roles.selection_profile(r.orderBy(F.desc("priority_score"), "gid").limit(30))), sql(f"SELECT count(*) AS n_nodes, sum(is_seed::INT)::BIGINT AS n_seeds, count(DISTINCT role) AS n_roles, count(DISTINCT cluster_id) AS n_clusters, {six('avg(seed_reach)')} AS mean_reach, CAST(sum(in_cents) AS BIGINT) AS in_cents FROM (SELECT * FROM pr ORDER BY priority_score DESC, gid LIMIT 30)", *priority)),
        "metric_overlap": (_plain(lambda n, r: stats.top_matrix(r, "gid", ("in_deg", "out_deg", "in_tx", "out_tx"), 50)), sql("SELECT x.m AS a, y.m AS b, count(*) AS shared FROM tt x JOIN tt y USING (gid) GROUP BY x.m, y.m", o.DEGREES, o.FLOWS, "tt AS (SELECT gid, m FROM (SELECT gid, m, row_number() OVER (PARTITION BY m ORDER BY v DESC, gid) AS r FROM (SELECT gid, 'in_deg' AS m, in_deg AS v FROM deg UNION ALL SELECT gid, 'out_deg', out_deg FROM deg UNION ALL SELECT gid, 'in_tx', in_tx FROM fl UNION ALL SELECT gid, 'out_tx', out_tx FROM fl)) WHERE r <= 50)")),
        "sampling_error": (_rows(lambda n, r: stats.metric_error(r.select("gid", "betweenness"), centrality.betweenness(n, 64), "gid", "betweenness")), None),
        "role_scenarios": (_cases(lambda m: m), sql(o.ALL_SCENARIOS, *o.SCENARIOS)),
        "role_stability": (_cases(roles.stability), sql(f"SELECT gid, count(DISTINCT role) AS roles, count(DISTINCT role) = 1 AS stable FROM ({o.ALL_SCENARIOS}) GROUP BY gid", *o.SCENARIOS)),
        "role_transitions": (_cases(lambda m: roles.role_changes(m, "relaxed", "strict")), sql("SELECT x.role AS before, y.role AS after, count(*) AS n FROM pr_relaxed x JOIN pr_strict y USING (gid) GROUP BY x.role, y.role", *o.SCENARIOS)),
        "scenario_comparison": (_cases(roles.compared), sql(f"""SELECT scenario, sum((role <> was)::INT)::BIGINT AS role_changes, count(DISTINCT cluster_id) AS clusters, sum((r <= 20 AND r0 <= 20)::INT)::BIGINT AS top20, sum((role <> was AND r0 <= 20)::INT)::BIGINT AS top20_changes, sum((r <= 50 AND r0 <= 50)::INT)::BIGINT AS top50, sum((role <> was AND r0 <= 50)::INT)::BIGINT AS top50_changes
          FROM ranked JOIN (SELECT gid, role AS was, r AS r0 FROM ranked WHERE scenario = 'base') USING (gid) GROUP BY scenario""", *o.SCENARIOS, f"ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY priority_score DESC, gid) AS r FROM ({o.ALL_SCENARIOS}))")),
        "pivot_scenarios": (_net(lambda n: roles.pivot_scenarios(n, by_twelve(n), 64)), " UNION ALL ".join(f"SELECT * FROM ({sql(f'SELECT {q}betweenness_seed_{k}{q} AS scenario, gid, cluster_id, role, priority_score FROM pr', *[o.sampled_sigma(64, k) if x is o.SIGMA else x for x in priority])})" for k in (0, 1, 7, 99) for q in ("'",))),
        "simple_rankings": (_rows(lambda n, r: roles.simple_rankings(r)), sql("""SELECT x.ranking, k, count(p.gid) AS shared FROM (SELECT unnest([20, 50])::INTEGER AS k), tt x LEFT JOIN pt p ON p.gid = x.gid AND p.r <= k WHERE x.r <= k GROUP BY x.ranking, k""", *priority,
          "pt AS (SELECT gid, row_number() OVER (ORDER BY priority_score DESC, gid) AS r FROM pr)", "tt AS (SELECT ranking, gid, row_number() OVER (PARTITION BY ranking ORDER BY v DESC, gid) AS r FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS ranking, gid, ({v})::DOUBLE AS v FROM pr" for name, v in (
            ("observed_flow_max", "greatest(in_cents, out_cents)"), ("observed_flow_in_plus_out", "in_cents + out_cents"), ("fanin", "in_deg"), ("fanout", "out_deg"), ("seed_reach", "seed_reach"), ("exact_betweenness", "betweenness"))) + "))")),
        "auc": (_plain(lambda n, r: stats.auc(seedish(r), "in_tx", "is_seed")), sql(f"SELECT p AS pos, m AS n, {six('(s - p * (p + 1) / 2.0) / (p * (m - p))')} AS auc FROM (SELECT sum(CASE WHEN is_seed THEN r END) AS s, sum(is_seed::INT)::BIGINT AS p, count(*) AS m FROM (SELECT is_seed, {ranks('in_tx')} AS r FROM fl JOIN nodes USING (gid)))", o.FLOWS)),
        "ks": (_plain(lambda n, r: stats.ks_distance(seedish(r), "in_tx", "is_seed")), sql(f"SELECT {six('max(abs(a / (SELECT count(*) FROM seeds) - b / (SELECT count(*) FROM nodes WHERE NOT is_seed)))')} AS ks FROM (SELECT DISTINCT in_tx, CAST(sum(is_seed::INT) OVER (ORDER BY in_tx) AS DOUBLE) AS a, CAST(sum((NOT is_seed)::INT) OVER (ORDER BY in_tx) AS DOUBLE) AS b FROM fl JOIN nodes USING (gid))", o.FLOWS)),
        "adjusted_rand": (_plain(lambda n, r: stats.adjusted_rand(r.join(paths.components(n), "gid"), "cluster_id", "component_id")), sql(f"SELECT {six('(ab - a * b / t) / ((a + b) / 2 - a * b / t)')} AS rand FROM (SELECT sum(c * (c - 1) / 2.0) AS ab FROM (SELECT count(*) AS c FROM cu JOIN cmp USING (gid) GROUP BY cluster_id, component_id)), (SELECT sum(c * (c - 1) / 2.0) AS a FROM (SELECT count(*) AS c FROM cu GROUP BY cluster_id)), (SELECT sum(c * (c - 1) / 2.0) AS b FROM (SELECT count(*) AS c FROM cmp GROUP BY component_id)), (SELECT count(*) * (count(*) - 1) / 2.0 AS t FROM nodes)", o.CLUSTER, o.ALL_COMPONENTS)),
        "spearman": (_plain(lambda n, r: stats.spearman(seedish(r), "in_deg", "out_deg")), sql(f"SELECT {six('corr(a, b)')} AS rho FROM (SELECT {ranks('in_deg')} AS a, {ranks('out_deg')} AS b FROM deg)", o.DEGREES)),
        "topk_overlap": (_plain(lambda n, r: stats.top_overlap(seedish(r), "gid", "in_deg", "out_deg", 25)), sql(f"SELECT count(*) FILTER (WHERE c = 2) AS shared, count(*) AS either, {six('count(*) FILTER (WHERE c = 2) / count(*)::DOUBLE')} AS jaccard FROM (SELECT gid, count(*) AS c FROM ((SELECT gid FROM deg ORDER BY in_deg DESC, gid LIMIT 25) UNION ALL (SELECT gid FROM deg ORDER BY out_deg DESC, gid LIMIT 25)) GROUP BY gid)", o.DEGREES)),
        "output_checks": (_rows(lambda n, r: checks(n, spoiled_rows(r))), sql("""SELECT sum((g = 1)::INT)::BIGINT AS bad_role, sum((g = 2)::INT)::BIGINT AS bad_score, sum((g = 3)::INT)::BIGINT AS bad_priority, sum((g = 4)::INT)::BIGINT AS repeated, sum((role = 'peripheral' AND g IN (1, 5))::INT)::BIGINT AS bad_reason
          FROM (SELECT gid % 10 AS g, role FROM rl)""", *scored[:-2])),
        "full_roles": (_run(lambda n, r: r.select("gid", "cluster_id", "role", "role_score", "priority_score")), None),
        "full_top": (_run(lambda n, r: roles.top_nodes(r)), None),
        "full_clusters": (_run(lambda n, r: _texts(roles.cluster_summary(n, r), "top_gids")), None),
        "search_filter": (_rows(lambda n, r: explore.search(roles.evidence(r), "1", "terminal").select("gid", "role", "depth")), sql("SELECT gid, role, depth FROM rl WHERE role = 'terminal' AND (contains(CAST(gid AS VARCHAR), '1') OR contains(CAST(in_deg AS VARCHAR), '1') OR contains(format('{:.2f}', in_cents / 100.0::DOUBLE), '1'))", *scored[:-2])),
        "kpis": (_plain(lambda n, r: explore.key_figures(n, r.where("depth <= 2"))), sql("SELECT (SELECT count(*) FROM nodes WHERE depth <= 2) AS n_nodes, (SELECT count(*) FROM seeds) AS n_seeds, (SELECT count(DISTINCT cluster_id) FROM cu JOIN nodes USING (gid) WHERE depth <= 2) AS n_clusters, count(*) AS n_edges, CAST(sum(n_tx) AS BIGINT) AS n_tx, CAST(sum(cents) AS BIGINT) AS cents FROM edges WHERE src IN (SELECT gid FROM nodes WHERE depth <= 2) AND dst IN (SELECT gid FROM nodes WHERE depth <= 2)", o.CLUSTER)),
        "role_mix": (_rows(lambda n, r: explore.role_mix(r)), sql(f"SELECT role, count(*) AS n, {six('count(*)::DOUBLE / (SELECT count(*) FROM nodes)')} AS share FROM rl GROUP BY role", *scored[:-2])),
        "tx_page": (_net(lambda n: explore.transaction_page(n, 3, 5, 20)), sql("SELECT src, dst, day, cents FROM tx WHERE src = 3 OR dst = 3 ORDER BY day, src, dst, cents LIMIT 20 OFFSET 5")),
        "table_page": (_plain(lambda n, r: explore.table_page(r, "in_cents", True, 1).select("gid", "in_cents")), sql("SELECT gid, in_cents FROM fl ORDER BY in_cents DESC, gid LIMIT 20 OFFSET 20", o.FLOWS)),
        "neighbours": (_net(lambda n: explore.neighbours(n, 3)), sql("SELECT * FROM (SELECT dst AS other, 'out' AS side, cents FROM links WHERE src = 3 UNION ALL SELECT src, 'in', cents FROM links WHERE dst = 3) ORDER BY cents DESC, other, side LIMIT 25")),
        "scene": (_rows(lambda n, r: explore.scene(n, r, 60).select("src", "dst", "cents")), sql("SELECT src, dst, cents FROM edges WHERE src IN (SELECT gid FROM t60) AND dst IN (SELECT gid FROM t60)", *priority, "t60 AS (SELECT gid FROM pr ORDER BY priority_score DESC, gid LIMIT 60)")),
    }


def _edge_queries() -> dict[str, tuple[Query, str | None]]:
    zero = lambda names: "SELECT unnest([" + ", ".join(f"'{c}'" for c in names) + "]) AS \"check\", CAST(0 AS BIGINT) AS violations"
    outputs = ("unique_ids", "known_role", "score_range", "truncated_cap", "reason_with_role", "cluster_sizes", "cluster_leaders", "top_order", "top_ranks")
    inputs = ("nodes", "degrees", "turnover", "truncation", "cluster_turnover")
    priority = o.PRIORITY
    stream = lambda s, d: monitor.read_transactions(s, table_path(s, d, "transactions"))
    burst = "SELECT gid, day, side, count(*) AS n FROM ends WHERE side = 'out' OR NOT own GROUP BY gid, day, side HAVING count(*) >= 5"
    closed = lambda part: part.replace("FROM tx", "FROM (SELECT * FROM tx WHERE day + 1 <= (SELECT max(day) FROM tx t2{}) - 3)")  # noqa: E731  days whose end the watermark, three days behind, has passed
    others = " WHERE src <> dst"
    return {
        "stream_fifo": (lambda s, d: matching.appended(matching.fifo_days(stream(s, d))).groupBy("gid").agg(F.sum("matched").alias("matched"), F.sum("same_day").alias("same_day"), F.sum("incoming").alias("total_in"), F.sum("outgoing").alias("total_out"), F.count("*").alias("active_days")), sql("SELECT gid, matched, same_day, total_in, total_out, active_days FROM f1", closed(o.ENDS).replace("{}", others), *o.fifo("f1", 2, 1))),
        "stream_transit_pairs": (lambda s, d: matching.appended(matching.transit_pairs(stream(s, d))), sql("SELECT i.dst AS gid, i.src AS payer, q.dst AS payee, CAST(q.day - i.day AS INTEGER) AS lag, i.cents AS in_cents, q.cents AS out_cents FROM tx i JOIN tx q ON q.src = i.dst AND q.day BETWEEN i.day AND i.day + 2 WHERE i.src <> i.dst AND q.src <> q.dst AND i.src <> q.dst AND least(i.cents, q.cents) * 100 >= greatest(i.cents, q.cents) * 85")),
        "stream_closed_bursts": (lambda s, d: matching.appended(matching.closed_bursts(stream(s, d), least=3)), sql("SELECT gid, day, side, count(*) AS n FROM ends WHERE side = 'out' OR NOT own GROUP BY gid, day, side HAVING count(*) >= 3", closed(o.ENDS).replace("{}", ""))),
        "verify_outputs": (_rows(_spoiled_outputs), sql("""SELECT unnest(['unique_ids', 'known_role', 'score_range', 'truncated_cap', 'reason_with_role', 'cluster_sizes', 'cluster_leaders', 'top_order', 'top_ranks']) AS "check", unnest([
          (SELECT count(*) FROM w WHERE g = 4), (SELECT count(*) FROM w WHERE g = 1), (SELECT count(*) FROM w WHERE g IN (2, 3)), (SELECT count(*) FROM w WHERE truncated AND g IN (2, 6)), (SELECT count(*) FROM w WHERE role = 'peripheral' AND g IN (1, 5)),
          2 * (SELECT count(*) FROM (SELECT cluster_id, count(*) FILTER (g = 4) AS d, count(*) FILTER (g = 4 AND is_seed) AS s FROM w GROUP BY cluster_id) WHERE d <> (cluster_id % 3 = 1)::INT OR s > 0), (SELECT count(DISTINCT cluster_id) FROM w WHERE cluster_id % 3 = 0),
          (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM t)), 1])::BIGINT AS violations""", *priority,
          "w AS (SELECT *, gid % 10 AS g FROM pr)", "k AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, gid) AS rank FROM w)", "t AS (SELECT gid, role, priority_score + (rank = 5)::INT AS priority_score FROM k WHERE rank <= greatest(20, least(50, (SELECT count(*) FROM nodes))))",
          "dd AS (SELECT gid, CASE WHEN g = 1 THEN 'boss' ELSE role END AS role, CASE WHEN g = 3 THEN -1.0 ELSE priority_score END AS priority_score FROM (SELECT * FROM w UNION ALL SELECT * FROM w WHERE g = 4))", "b AS (SELECT * FROM dd ORDER BY priority_score DESC, gid LIMIT (SELECT count(*) FROM t))")),
        "snapshot_checks": (_rows(_spoiled_snapshot), sql("""SELECT unnest(['repeated_pairs', 'pair_totals', 'node_totals']) AS "check", unnest([(SELECT count(*) FROM edges WHERE (src + dst) % 10 = 3), (SELECT count(*) FROM edges WHERE (src + dst) % 10 IN (1, 3)),
          (SELECT count(*) FROM fl LEFT JOIN (SELECT dst AS gid, sum(c) AS c, sum(t) AS t FROM sp GROUP BY dst) i USING (gid) LEFT JOIN (SELECT src AS gid, sum(c) AS c, sum(t) AS t FROM sp GROUP BY src) o USING (gid)
           WHERE in_cents + (gid % 10 = 2)::INT <> coalesce(i.c, 0) OR in_tx <> coalesce(i.t, 0) OR out_cents <> coalesce(o.c, 0) OR out_tx <> coalesce(o.t, 0))])::BIGINT AS violations""", o.FLOWS, "sp AS (SELECT src, dst, (cents + ((src + dst) % 10 = 1)::INT) * (1 + ((src + dst) % 10 = 3)::INT) AS c, n_tx * (1 + ((src + dst) % 10 = 3)::INT) AS t FROM edges)")),
        "verify_inputs": (_rows(_spoiled_figures), sql("""SELECT unnest(['nodes', 'degrees', 'turnover', 'truncation', 'cluster_turnover']) AS "check", 2 * unnest([(SELECT count(*) FROM nodes WHERE gid % 10 = 3), (SELECT count(*) FROM nodes WHERE gid % 10 = 1), (SELECT count(*) FROM nodes WHERE gid % 10 = 2), (SELECT count(*) FROM nodes WHERE gid % 10 = 4),
          (SELECT count(*) FROM (SELECT a.cluster_id FROM edges JOIN cu a ON a.gid = src JOIN cu b ON b.gid = dst WHERE a.cluster_id = b.cluster_id AND a.cluster_id % 3 = 0 GROUP BY a.cluster_id HAVING sum(cents) > 0))])::BIGINT AS violations""", o.CLUSTER)),
        "verify_clean": (_rows(lambda n, r: verify.check_outputs(r, roles.cluster_summary(n, r), roles.top_nodes(r)).unionByName(verify.check_against_inputs(n, r, roles.cluster_summary(n, r)))), zero(outputs + inputs)),
        "input_digests": (lambda s, d: file_digests(s, f"{d}/events.parquet"), None),
        "stream_bursts": (lambda s, d: monitor.drain(monitor.burst_counts(stream(s, d))), sql(burst, o.ENDS)),
        "stream_repeats": (lambda s, d: monitor.drain(monitor.repeat_counts(stream(s, d))), sql("SELECT src, dst, cents, count(*) AS n FROM tx WHERE src <> dst GROUP BY src, dst, cents HAVING count(*) >= 3")),
    }


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**_network_queries(), **_role_queries(), **_edge_queries()}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in _all().items() if s}
