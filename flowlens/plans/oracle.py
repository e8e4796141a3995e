"""SQL for a second engine (DuckDB): the derived network as common table expressions, and a body for each query."""

from __future__ import annotations

from flowlens.operators.roles import RoleConfig, threshold_scenarios

NETWORK = """WITH RECURSIVE
n AS (SELECT max(user_id) + 1 AS n FROM events),
ev AS (SELECT user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(ts AS DATE) AS d, value FROM events
  WHERE event_type = 'purchase' AND NOT (user_id % 11 = 0 AND user_id % 28 <> 0)),
mv AS (SELECT u AS src, CASE k % 5 WHEN 0 THEN (2 * u + 1) % n WHEN 1 THEN (u + 1) % n WHEN 2 THEN (7 * u + 3) % n WHEN 3 THEN (u // 10) * 10 ELSE (u * u + 5) % n END AS dst,
  500000 + 100000 * CAST(floor(value / 25) AS BIGINT) AS cents, d AS day FROM ev, n),
rr(gid, depth) AS (SELECT DISTINCT src, 0 FROM mv WHERE src % 28 = 0 UNION SELECT mv.dst, rr.depth + 1 FROM rr JOIN mv ON mv.src = rr.gid WHERE rr.depth < 4),
dp AS (SELECT gid, min(depth) AS depth FROM rr GROUP BY gid),
nodes AS (SELECT gid, depth, depth = 0 AS is_seed FROM dp UNION ALL SELECT n + i, 0, true FROM n, range(0, CAST(ceil((SELECT n FROM n) / 50.0) AS BIGINT)) t(i)),
tx AS (SELECT src, dst, day, cents FROM mv JOIN dp ON gid = src WHERE depth < 4),
edges AS (SELECT src, dst, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_tx, any_value(depth) + 1 AS depth FROM mv JOIN dp ON gid = src WHERE depth < 4 GROUP BY src, dst),
links AS (SELECT * FROM edges WHERE src <> dst),
seeds AS (SELECT gid AS seed FROM nodes WHERE is_seed)"""


def six(x: str) -> str:
    return f"round_even(({x}) * 1e6, 0) / 1e6"


def sql(body: str, *parts: str) -> str:
    """The network, further table expressions, and the query."""
    return ",\n".join([NETWORK, *parts]) + "\n" + body


DEGREES = """deg AS (SELECT gid, coalesce(i.c, 0) AS in_deg, coalesce(o.c, 0) AS out_deg FROM nodes
  LEFT JOIN (SELECT dst, count(*) AS c FROM links GROUP BY dst) i ON i.dst = gid LEFT JOIN (SELECT src, count(*) AS c FROM links GROUP BY src) o ON o.src = gid)"""
FLOWS = f"""fl AS (SELECT gid, coalesce(i.c, 0) AS in_cents, coalesce(o.c, 0) AS out_cents, coalesce(i.e, 0) AS ext_in_cents, coalesce(o.e, 0) AS ext_out_cents, coalesce(i.t, 0) AS in_tx, coalesce(o.t, 0) AS out_tx,
  CASE WHEN coalesce(i.e, 0) > 0 THEN {six("CAST(coalesce(o.e, 0) AS DOUBLE) / i.e")} END AS pass_through FROM nodes
  LEFT JOIN (SELECT dst, CAST(sum(cents) AS BIGINT) AS c, CAST(sum(CASE WHEN src <> dst THEN cents ELSE 0 END) AS BIGINT) AS e, CAST(sum(n_tx) AS BIGINT) AS t FROM edges GROUP BY dst) i ON i.dst = gid
  LEFT JOIN (SELECT src, CAST(sum(cents) AS BIGINT) AS c, CAST(sum(CASE WHEN src <> dst THEN cents ELSE 0 END) AS BIGINT) AS e, CAST(sum(n_tx) AS BIGINT) AS t FROM edges GROUP BY src) o ON o.src = gid)"""
TRUNCATED = "tr AS (SELECT gid, depth = 4 AND out_deg = 0 AS truncated FROM deg JOIN nodes USING (gid))"
ENDS = "ends AS (SELECT src AS gid, day, src = dst AS own, 'out' AS side, cents, src, dst FROM tx UNION ALL SELECT dst, day, src = dst, 'in', cents, src, dst FROM tx)"
ACTIVE = "ad AS (SELECT gid, coalesce(d, 0) AS active_days FROM nodes LEFT JOIN (SELECT gid, count(DISTINCT day) AS d FROM ends WHERE NOT own GROUP BY gid) USING (gid))"
REACH = "wk(seed, node, h) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT wk.seed, links.dst, wk.h + 1 FROM wk JOIN links ON links.src = wk.node WHERE wk.h < 4),\nreach AS (SELECT DISTINCT seed, node FROM wk WHERE seed <> node)"
SEED_REACH = "sr AS (SELECT gid, coalesce(c, 0) AS seed_reach FROM nodes LEFT JOIN (SELECT node, count(*) AS c FROM reach GROUP BY node) ON node = gid)"
#: Walk counts by length: the shortest length with walks is the distance, and its walks are shortest paths.
SIGMA = """wc(s, v, l, c) AS (SELECT gid, gid, 0, CAST(1 AS DOUBLE) FROM nodes UNION ALL SELECT wc.s, links.dst, wc.l + 1, sum(wc.c) FROM wc JOIN links ON links.src = wc.v WHERE wc.l < 14 GROUP BY wc.s, links.dst, wc.l + 1),
sg AS (SELECT s, v, min(l) AS d, arg_min(c, l) AS c FROM wc GROUP BY s, v),
bt AS (SELECT gid, round_even(coalesce(b, 0.0) / ((m - 1) * (m - 2)) * 1e9, 0) / 1e9 AS betweenness FROM nodes CROSS JOIN (SELECT count(*) AS m FROM nodes) LEFT JOIN
  (SELECT x.v AS v, sum(x.c * y.c / z.c) AS b FROM sg x JOIN sg y ON x.v = y.s JOIN sg z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v GROUP BY x.v) ON v = gid)"""


def sampled_sigma(k: int, seed: int = 42) -> str:
    """SIGMA with dependencies of k sources alone, those of the smallest MD5 of `seed:gid`, scaled by nodes over k."""
    own = SIGMA.replace("WHERE x.s <> x.v AND", "WHERE x.s IN (SELECT gid FROM pv) AND x.s <> x.v AND").replace("/ ((m - 1) * (m - 2)) * 1e9", f"/ ((m - 1) * (m - 2)) * (m / least({k}, m)) * 1e9")
    return f"pv AS (SELECT gid FROM nodes ORDER BY md5('{seed}:' || gid), gid LIMIT {k}),\n{own}"


CYCLES = """cp(root, cur, members, length) AS (SELECT src, dst, [src, dst], 2 FROM links WHERE dst > src UNION ALL
  SELECT cp.root, links.dst, list_append(cp.members, links.dst), cp.length + 1 FROM cp JOIN links ON links.src = cp.cur WHERE links.dst > cp.root AND NOT list_contains(cp.members, links.dst) AND cp.length < {longest}),
cy AS (SELECT cp.members, cp.length FROM cp JOIN links ON links.src = cp.cur AND links.dst = cp.root)"""
COMPONENT = """und AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
cl(gid, r) AS (SELECT gid, gid FROM nodes UNION SELECT und.b, cl.r FROM cl JOIN und ON und.a = cl.gid WHERE cl.r < und.b),
rt AS (SELECT gid, min(r) AS r FROM cl GROUP BY gid),
cmp AS (SELECT gid, dense_rank() OVER (ORDER BY r) - 1 AS component_id FROM rt)"""
ALL_COMPONENTS, MONEY_COMPONENTS = COMPONENT.format(edges="edges"), COMPONENT.format(edges="(SELECT * FROM links WHERE cents > 0)")


def fifo(name: str, window: int, min_lag: int = 0, self_transfers: bool = False) -> tuple[str, ...]:
    """Table expressions ending in `name` (gid, matched, same_day, total_in, total_out, in_fraction, out_fraction, active_days)."""
    which = "" if self_transfers else "WHERE NOT own"
    p = f"q_{name}"
    daily = f"""{p}_d AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY day) AS i FROM (SELECT gid, day, CAST(sum(CASE WHEN side = 'in' THEN cents ELSE 0 END) AS BIGINT) AS inn, CAST(sum(CASE WHEN side = 'out' THEN cents ELSE 0 END) AS BIGINT) AS outt FROM ends {which} GROUP BY gid, day))"""
    queue = f"list_concat(list_filter(f.q, lambda x: x.day >= d.day - {window}), CASE WHEN d.inn > 0 THEN [{{'day': d.day, 'amt': d.inn}}] ELSE [] END)"
    ready = f"coalesce(list_sum(list_transform(list_filter(w.q, lambda x: x.day <= w.day - {min_lag}), lambda x: x.amt)), 0)"
    older = "coalesce(list_sum(list_transform(list_filter(w.q, lambda x: x.day < w.day), lambda x: x.amt)), 0)"
    left = f"list_filter(list_transform(w.q, lambda x, j: {{'day': x.day, 'amt': x.amt - CASE WHEN x.day <= w.day - {min_lag} THEN CAST(least(x.amt, greatest(w.outt - coalesce(list_sum(list_transform(list_slice(w.q, 1, j - 1), lambda y: y.amt)), 0), 0)) AS BIGINT) ELSE 0 END}}), lambda x: x.amt > 0)"
    same = f"CAST(least(w.inn, greatest(w.outt - {older}, 0)) AS BIGINT)" if min_lag == 0 else "0"
    fold = f"""{p}_f(gid, i, q, matched, same_day) AS (SELECT DISTINCT gid, CAST(0 AS BIGINT), CAST([] AS STRUCT(day DATE, amt BIGINT)[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {p}_d UNION ALL
  SELECT w.gid, w.i, {left}, w.matched + CAST(least(w.outt, {ready}) AS BIGINT), w.same_day + {same}
  FROM (SELECT d.gid, d.i, d.day, d.inn, d.outt, f.matched, f.same_day, {queue} AS q FROM {p}_f f JOIN {p}_d d ON d.gid = f.gid AND d.i = f.i + 1) w)"""
    total = f"""{name} AS (SELECT gid, max(matched) AS matched, max(same_day) AS same_day, any_value(ti) AS total_in, any_value(tot) AS total_out,
  CASE WHEN any_value(ti) > 0 THEN {six("CAST(max(matched) AS DOUBLE) / any_value(ti)")} ELSE 0 END AS in_fraction, CASE WHEN any_value(tot) > 0 THEN {six("CAST(max(matched) AS DOUBLE) / any_value(tot)")} ELSE 0 END AS out_fraction, max(i) AS active_days
  FROM {p}_f JOIN (SELECT gid, CAST(sum(inn) AS BIGINT) AS ti, CAST(sum(outt) AS BIGINT) AS tot FROM {p}_d GROUP BY gid) USING (gid) GROUP BY gid)"""
    return daily, fold, total


PAIRS = """fp AS (SELECT i.dst AS gid, i.src AS payer, o.dst AS payee, i.cents AS a, o.cents AS b FROM tx i JOIN tx o ON i.dst = o.src AND o.day - i.day BETWEEN 0 AND 2 WHERE i.src <> i.dst AND o.src <> o.dst)"""
EDGE_DAYS = "ed AS (SELECT DISTINCT src, dst, day FROM tx WHERE src <> dst)"


def temporal(name: str, op: str) -> str:
    return f"""{name}_s(seed, node, day, h) AS (SELECT seed, seed, CAST('1900-01-01' AS DATE), 0 FROM seeds UNION SELECT {name}_s.seed, ed.dst, ed.day, {name}_s.h + 1 FROM {name}_s JOIN ed ON ed.src = {name}_s.node AND ed.day {op} {name}_s.day WHERE {name}_s.h < 4),
{name} AS (SELECT seed, node, min(day) AS day FROM {name}_s WHERE h > 0 AND seed <> node GROUP BY seed, node)"""


CLUSTER = "cu AS (SELECT gid, gid // 12 AS cluster_id FROM nodes)"
OTHERS = """oc AS (SELECT gid, coalesce(c, 0) AS other_clusters FROM nodes LEFT JOIN (SELECT g, count(DISTINCT cb.cluster_id) AS c FROM (SELECT src AS g, dst AS o FROM links UNION SELECT dst, src FROM links) p JOIN cu ca ON ca.gid = g JOIN cu cb ON cb.gid = o WHERE ca.cluster_id <> cb.cluster_id GROUP BY g) ON g = gid)"""
FEATURES = (DEGREES, FLOWS, TRUNCATED, ENDS, ACTIVE, REACH, SEED_REACH, SIGMA, CLUSTER, OTHERS, *fifo("f0", 2, 0), *fifo("f1", 2, 1))


def ruled(config: RoleConfig = RoleConfig(), tag: str = "") -> tuple[str, ...]:
    """The rules under one configuration: th, hold, rl, rs and sc, each name followed by tag."""
    c = config
    band = f"pass_through BETWEEN {c.transit_ratio_min!r}::DOUBLE AND {c.transit_ratio_max!r}::DOUBLE"
    return (
        f"th{tag} AS (SELECT coalesce(quantile_cont(betweenness, {c.coordinator_centrality_quantile}), 0) AS threshold FROM ft WHERE in_deg + out_deg > 0)",
        f"""hold{tag} AS (SELECT ft.*, in_deg + out_deg >= {c.coordinator_min_degree} AND betweenness > 0 AND betweenness >= threshold - 1e-12 AND other_clusters >= {c.coordinator_min_other_clusters} AND seed_reach >= {c.coordinator_min_seeds} AS c1,
  out_deg >= {c.distributor_min_payees} AND out_deg >= {c.distributor_fan_ratio!r}::DOUBLE * greatest(in_deg, 1) AS c2, in_deg >= {c.consolidator_min_payers} AND seed_reach >= {c.consolidator_min_seeds} AS c3,
  reliable AND in_deg > 0 AND out_deg > 0 AND {band} AND least(coalesce(ti, 0), coalesce(tout, 0)) >= {c.transit_min_matched_fraction} AS c4, reliable AND out_deg = 0 AS c5 FROM ft, th{tag})""",
        f"""rl{tag} AS (SELECT *, CASE WHEN c1 THEN 'coordinator' WHEN c2 THEN 'distributor' WHEN c3 THEN 'consolidator' WHEN c4 THEN 'transit' WHEN c5 THEN 'terminal' ELSE 'peripheral' END AS role FROM hold{tag})""",
        f"""rs{tag} AS (SELECT *, CASE role WHEN 'coordinator' THEN 6 + (seed_reach >= 5)::INT + (other_clusters >= 3)::INT + (active_days >= 3)::INT WHEN 'distributor' THEN 6 + (out_deg >= 10)::INT + (active_days >= 3)::INT + (out_tx >= 2 * greatest(out_deg, 1))::INT
  WHEN 'consolidator' THEN 6 + (in_deg >= 10)::INT + (seed_reach >= 3)::INT + coalesce(reliable AND pass_through <= 0.3, false)::INT WHEN 'transit' THEN 6 + (pass_through BETWEEN 0.9 AND 1.1)::INT + (least(coalesce(si, 0), coalesce(so, 0)) >= {c.transit_min_matched_fraction})::INT + (active_days >= 3)::INT
  WHEN 'terminal' THEN 6 + (in_deg >= 2)::INT + (in_tx >= 3)::INT + (active_days >= 3)::INT ELSE 2 END AS pts FROM rl{tag})""",
        f"sc{tag} AS (SELECT *, (CASE WHEN truncated THEN least(pts, 6) ELSE pts END) / 10.0 AS role_score FROM rs{tag})",
    )


ROLES = (
    *FEATURES,
    """ft AS (SELECT *, NOT is_seed AND NOT truncated AND ext_in_cents > 0 AS reliable FROM nodes JOIN deg USING (gid) JOIN fl USING (gid) JOIN tr USING (gid) JOIN ad USING (gid) JOIN sr USING (gid) JOIN oc USING (gid) JOIN bt USING (gid) JOIN cu USING (gid)
  LEFT JOIN (SELECT gid, in_fraction AS ti, out_fraction AS tout FROM f0) USING (gid) LEFT JOIN (SELECT gid, in_fraction AS si, out_fraction AS so FROM f1) USING (gid))""",
    *ruled(),
)


def share(column: str) -> str:
    """Average rank over active rows, as a part of their number."""
    return f"CASE WHEN {column} > 0 THEN (rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0) / count(*) OVER () ELSE 0 END"


ACTIVE_SHARES = f"""ac AS (SELECT gid, {share("big")} AS p1, {share("bb")} AS p2, {share("fan")} AS p3 FROM (SELECT gid, greatest(in_cents, out_cents) AS big, betweenness AS bb, greatest(in_deg, out_deg) AS fan FROM ft WHERE in_deg + out_deg > 0))"""


def scored(tag: str = "", w: dict[str, float] = RoleConfig().priority_weights, of: str | None = None) -> str:
    """pr: priority of the rows of sc, each name followed by tag; of: the tag of sc, if another."""
    sc = f"sc{tag if of is None else of}"
    a, b, c, d, e = (repr(w[k]) for k in ("seed_reach", "flow", "bridge", "fan", "role_support"))
    support = "CASE WHEN role = 'peripheral' THEN 0 ELSE role_score END"
    return f"""pr{tag} AS (SELECT {sc}.*, CASE WHEN in_deg + out_deg > 0 THEN {six(f"{a} * least(seed_reach / 5.0, 1) + {b} * p1 + {c} * p2 + {d} * p3 + {e} * {support}")} ELSE 0 END AS priority_score,
  {a} * least(seed_reach / 5.0, 1) AS x_seed_reach, {b} * coalesce(p1, 0) AS x_flow, {c} * coalesce(p2, 0) AS x_bridge, {d} * coalesce(p3, 0) AS x_fan, {e} * {support} AS x_role_support FROM {sc} LEFT JOIN ac USING (gid))"""


PRIORITY = (*ROLES, ACTIVE_SHARES, scored())
SCENARIOS = (*ROLES, ACTIVE_SHARES, *[x for name, c in threshold_scenarios().items() for x in (*ruled(c, f"_{name}"), scored(f"_{name}"))])
ALL_SCENARIOS = " UNION ALL ".join(f"SELECT '{name}' AS scenario, gid, cluster_id, role, priority_score FROM pr_{name}" for name in threshold_scenarios())
#: The tables of sources.fixture.spoiled.
SPOILED = (
    "bn AS (SELECT CASE WHEN gid % 10 = 4 THEN -gid - 1 ELSE gid END AS gid, CASE WHEN gid % 10 = 1 THEN depth + 5 WHEN gid % 10 <> 5 THEN depth END AS depth, CASE WHEN gid % 10 = 2 THEN NOT is_seed ELSE is_seed END AS is_seed FROM (SELECT * FROM nodes UNION ALL SELECT * FROM nodes WHERE gid % 10 = 3))",
    "be AS (SELECT src, dst, (src + dst) % 10 AS p, cents, CASE WHEN (src + dst) % 10 = 1 THEN 0 ELSE n_tx END AS n_tx, CASE WHEN (src + dst) % 10 = 4 THEN 9 ELSE depth END AS depth FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE (src + dst) % 10 = 3))",
    "bt AS (SELECT src, CASE WHEN (src + dst) % 10 = 8 THEN dst + 1000000 ELSE dst END AS dst, (src + dst) % 10 AS p FROM tx)",
)
