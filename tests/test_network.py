"""Hand-made networks with known answers, and invariance under shuffling."""

from __future__ import annotations

import datetime as dt
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from flowlens.operators import centrality, communities, fifo, flows, motifs, paths, roles, validate, verify
from flowlens.operators.components import component_roots
from flowlens.sources import sinks
from flowlens.sources.tables import DataError, as_network, read_raw, require_types

DAY = dt.date(2026, 7, 1)


def tables(spark, nodes, moved):
    """Tables from (gid, depth) and (src, dst, day number, amount)."""
    depth = dict(nodes)
    n = spark.createDataFrame([(g, d, d == 0) for g, d in nodes], "gid long, depth int, is_seed boolean")
    t = spark.createDataFrame([(s, d, DAY + dt.timedelta(day - 1), float(a)) for s, d, day, a in moved], "src long, dst long, date date, sum_kzt double")
    total = {}
    for s, d, _, a in moved:
        x = total.setdefault((s, d), [0.0, 0])
        x[0] += a
        x[1] += 1
    e = spark.createDataFrame([(s, d, float(a), k, min(4, depth[s] + 1)) for (s, d), (a, k) in total.items()], "src long, dst long, sum_kzt double, n_tx long, depth int")
    return {"nodes": n, "edges": e, "transactions": t}


def make(spark, nodes, moved):
    return as_network(**tables(spark, nodes, moved))


SMALL = ([(10, 0), (20, 1), (30, 2), (40, 4), (50, 0)], [(10, 20, 1, 10000), (20, 30, 2, 6000), (20, 40, 2, 4000)])


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def series(spark, *events):
    """Node 2 between payers 1 and payees 3, from (side, day, amount)."""
    return make(spark, [(1, 0), (2, 1), (3, 2)], [(1, 2, d, a) if side == "in" else (2, 3, d, a) for side, d, a in events])


@pytest.mark.parametrize(
    ("events", "window", "lag", "matched", "same_day"),
    [
        ([("in", 1, 100), ("out", 2, 40), ("out", 3, 60)], 2, 0, 100, 0),
        ([("in", 1, 40), ("in", 2, 60), ("out", 3, 100)], 2, 0, 100, 0),
        ([("out", 1, 50), ("in", 2, 100), ("out", 3, 35), ("out", 3, 35)], 2, 0, 70, 0),
        ([("in", 1, 100), ("out", 1, 100)], 2, 0, 100, 100),
        ([("in", 1, 100), ("out", 1, 100)], 2, 1, 0, 0),
        ([("in", 1, 100), ("out", 4, 100)], 2, 0, 0, 0),
        ([("in", 1, 100), ("out", 4, 100)], 3, 0, 100, 0),
        ([("out", 1, 100), ("in", 2, 100)], 2, 0, 0, 0),
        ([("in", 1, 100), ("in", 3, 100), ("out", 1, 80), ("out", 2, 80), ("out", 6, 100)], 2, 0, 100, 80),
    ],
)
def test_fifo_series(spark, events, window, lag, matched, same_day):
    r = one(fifo.fifo(series(spark, *events), window, lag).where("gid = 2"))
    assert (r["matched"], r["same_day"]) == (matched * 100, same_day * 100)


def test_fifo_against_a_queue(spark):
    """The fold matches a plain queue, on many random series, for every rule of lag."""
    import random

    rng = random.Random(3)
    made = {g: [(d, rng.randint(0, 5), rng.randint(0, 5)) for d in sorted(rng.sample(range(1, 15), 8))] for g in range(100, 140)}
    moved = [(1, g, d, i) for g, days in made.items() for d, i, _ in days if i] + [(g, 2, d, o) for g, days in made.items() for d, _, o in days if o]
    net = make(spark, [(1, 0), (2, 2), *[(g, 1) for g in made]], moved)
    for window, lag in ((2, 0), (2, 1), (5, 2), (0, 0)):
        got = {r["gid"]: r["matched"] for r in fifo.fifo(net, window, lag).collect()}
        for g, days in made.items():
            queue, total = [], 0
            for d, i, o in days:
                queue = [[x, a] for x, a in queue if x >= d - window] + ([[d, i]] if i else [])
                for x in queue:
                    if x[0] <= d - lag:
                        used = min(o, x[1])
                        o, x[1], total = o - used, x[1] - used, total + used
                queue = [x for x in queue if x[1]]
            assert got[g] == total * 100


def test_stopping_and_skipping_agree(spark):
    """A queue that stops at its first too young entry and one that looks past it match the same, as days come in order."""
    import random

    rng = random.Random(9)
    made = {g: [(d, rng.randint(0, 4), rng.randint(0, 6)) for d in sorted(rng.sample(range(1, 12), 7))] for g in range(100, 130)}
    moved = [(1, g, d, i) for g, days in made.items() for d, i, _ in days if i] + [(g, 2, d, o) for g, days in made.items() for d, _, o in days if o]
    net = make(spark, [(1, 0), (2, 2), *[(g, 1) for g in made]], moved)

    def matched(days, window, lag, skip):
        queue, total = [], 0
        for d, i, o in days:
            queue = [x for x in queue if x[0] >= d - window and x[1]] + ([[d, i]] if i else [])
            for x in queue:
                if x[0] > d - lag:
                    if skip:
                        continue
                    break
                used = min(o, x[1])
                o, x[1], total = o - used, x[1] - used, total + used
        return total

    for window, lag in ((3, 1), (7, 2)):
        got = {r["gid"]: r["matched"] for r in fifo.fifo(net, window, lag).collect()}
        for g, days in made.items():
            assert got.get(g, 0) == 100 * matched(days, window, lag, True) == 100 * matched(days, window, lag, False)


def test_self_transfers_count_for_turnover_only(spark):
    net = make(spark, [(1, 0), (2, 1), (3, 2)], [(1, 2, 1, 100), (2, 2, 1, 900), (2, 3, 2, 40), (2, 3, 3, 60)])
    r = one(flows.flows(net).where("gid = 2"))
    assert (r["in_cents"], r["out_cents"], r["ext_in_cents"], r["ext_out_cents"], r["pass_through"]) == (100000, 100000, 10000, 10000, 1.0)
    assert one(fifo.fifo(net).where("gid = 2"))["matched"] == 10000


def test_small_network_end_to_end(spark, tmp_path):
    net = make(spark, *SMALL)
    clusters = communities.communities(net)
    rows = roles.prioritise(roles.classify(roles.features(net, clusters)))
    got = {r["gid"]: r for r in rows.collect()}
    assert got[20]["role"] == "transit" and got[30]["role"] == "terminal" and got[40]["role"] == "peripheral"
    assert got[40]["peripheral_reason"] == "truncated" and got[50]["peripheral_reason"] == "isolated" and got[50]["priority_score"] == 0
    summary, top = roles.cluster_summary(net, rows), roles.top_nodes(rows)
    assert all(r["violations"] == 0 for r in verify.check_outputs(rows, summary, top).unionByName(verify.check_against_inputs(net, rows, summary)).collect())
    assert all(len(r["evidence"]) <= 200 for r in roles.evidence(rows).collect())
    wrong = rows.withColumn("in_deg", F.when(F.col("gid") == 30, 7).otherwise(F.col("in_deg")).cast("long"))
    assert {r["check"] for r in verify.check_against_inputs(net, wrong, summary).collect() if r["violations"]} == {"degrees"}
    manifest = sinks.write_snapshot(spark, str(tmp_path / "snap"), net, rows, summary, top, {"window": 2})
    assert manifest["tables"]["nodes"]["rows"] == 5
    again, found = sinks.read_snapshot(spark, str(tmp_path / "snap"))
    assert again == manifest and found["edges"].count() == 3
    run = sinks.read_run(spark, str(tmp_path / "snap"))
    assert one(verify.check_run(run))["violations"] == 0 and '"nodes":5' in run.first()["rows"].replace(" ", "")
    metrics = spark.read.json(str(tmp_path / "snap" / "metrics"))
    assert {r["gid"]: r["role"] for r in metrics.collect()}["20"] == "transit" and metrics.count() == 5
    assert all(r["violations"] == 0 for r in sinks.snapshot_faults(found).collect())
    net.edges.limit(1).write.mode("overwrite").parquet(str(tmp_path / "snap" / "edges"))
    with pytest.raises(ValueError, match="edges"):
        sinks.read_snapshot(spark, str(tmp_path / "snap"))
    sinks.write_csv(top, str(tmp_path / "top"))
    assert spark.read.option("header", True).csv(str(tmp_path / "top")).count() == 5


def test_isolates_only(spark):
    t = tables(spark, *SMALL)
    net = as_network(t["nodes"], t["edges"].where("false"), t["transactions"].where("false"))
    rows = roles.prioritise(roles.classify(roles.features(net, communities.communities(net)))).collect()
    assert len(rows) == 5 and {r["role"] for r in rows} == {"peripheral"} and {r["priority_score"] for r in rows} == {0.0}
    assert len({r["cluster_id"] for r in rows}) == 5
    assert paths.cycles(net).count() == paths.strong_components(net).count() == motifs.detect(net).count() == 0


def test_digest_ignores_order(spark):
    net = make(spark, *SMALL)
    assert sinks.digest(net.tx) == sinks.digest(net.tx.repartition(3).orderBy(F.rand(7)))
    assert sinks.digest(net.tx) != sinks.digest(net.tx.unionByName(net.tx.limit(1)))


def counts(t):
    return {r["check"]: r["violations"] for r in validate.violations(**t).collect() if r["violations"]}


def test_validation_counts(spark):
    t = tables(spark, *SMALL)
    assert counts(t) == {}
    edges, nodes, tx = t["edges"], t["nodes"], t["transactions"]
    assert counts({**t, "edges": edges.withColumn("sum_kzt", F.col("sum_kzt") + 0.001)}) == {"edges_money": 3}
    assert counts({**t, "edges": edges.unionByName(edges.limit(1))}) == {"edges_unique": 1}
    assert counts({**t, "nodes": nodes.where("gid <> 30")}) == {"ids_known": 1}
    assert counts({**t, "nodes": nodes.withColumn("is_seed", F.lit(True))}) == {"nodes_seed": 3}
    assert counts({**t, "transactions": tx.withColumn("date", F.when(F.col("dst") == 30, "not a day").otherwise(F.col("date").cast("string")))}) == {"tx_date": 1}
    assert counts({**t, "transactions": tx.withColumn("sum_kzt", F.lit(None).cast("double"))}) == {"tx_null": 3}
    assert one(validate.reconcile(as_network(**{**t, "transactions": tx.where("dst <> 30")})))["only_edges"] == 1
    more = one(validate.reconcile(as_network(**{**t, "edges": edges.withColumn("n_tx", F.col("n_tx") + 1)})))
    assert more["counts_differ"] == 3 and more["cents_differ"] == 0


def test_types_are_not_coerced(spark, tmp_path):
    t = tables(spark, *SMALL)
    for name, column, kind in (("nodes", "gid", "double"), ("nodes", "is_seed", "int"), ("edges", "n_tx", "string"), ("transactions", "date", "long"), ("edges", "sum_kzt", "string")):
        with pytest.raises(DataError, match=column):
            require_types(name, t[name].withColumn(column, F.lit(None).cast(kind)))
    with pytest.raises(DataError, match="missing"):
        require_types("nodes", t["nodes"].drop("depth"))
    for name, df in t.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {k: v.count() for k, v in read_raw(spark, str(tmp_path)).items()} == {"nodes": 5, "edges": 3, "transactions": 3}


def test_large_ids_stay_exact(spark):
    far = 100_000_000_000_000_001
    net = make(spark, [(far, 0), (far + 1, 1)], [(far, far + 1, 1, 5000)])
    assert {r["gid"] for r in flows.degrees(net).where("in_deg + out_deg = 1").collect()} == {far, far + 1}
    assert one(flows.exact_ids(net))["altered"] == 2


def graph(spark, pairs):
    ids = sorted({x for p in pairs for x in p})
    return make(spark, [(g, 0 if g == ids[0] else 1) for g in ids], [(a, b, 1, 10) for a, b in pairs])


def plain_betweenness(ids, pairs):
    out = {i: [] for i in ids}
    for a, b in pairs:
        if a != b:
            out[a].append(b)
    score = dict.fromkeys(ids, Fraction(0))
    for s in ids:
        dist, paths_, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                    paths_[w] = 0
                if dist[w] == dist[v] + 1:
                    paths_[w] += paths_[v]
        delta = dict.fromkeys(order, Fraction(0))
        for w in reversed(order):
            for v in order:
                if w in out[v] and dist[w] == dist[v] + 1:
                    delta[v] += Fraction(paths_[v], paths_[w]) * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(ids)
    return {i: float(x / ((n - 1) * (n - 2))) for i, x in score.items()}


@pytest.mark.parametrize("small", [10**6, 0])
def test_betweenness_both_ways(spark, small):
    import random

    rng = random.Random(5)
    pairs = sorted({(rng.randrange(18), rng.randrange(18)) for _ in range(50)} | {(i, i + 1) for i in range(17)})
    got = {r["gid"]: r["betweenness"] for r in centrality.betweenness(graph(spark, pairs), small_links=small).collect()}
    assert got == pytest.approx(plain_betweenness(range(18), pairs), abs=1e-8)


def test_sampled_betweenness_of_all_is_exact(spark):
    net = graph(spark, [(i, i + 1) for i in range(6)] + [(2, 5), (6, 0)])
    assert centrality.betweenness(net, 100).exceptAll(centrality.betweenness(net)).count() == 0


def test_components_of_a_long_path(spark):
    """A path whose ids alternate, a star and a self-loop: the smallest id reaches everyone."""
    path = [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(400)]
    edges = spark.createDataFrame(path + [(2000, 2000 + i) for i in range(1, 50)] + [(5000, 5000)], "src long, dst long")
    got = {r["node"]: r["root"] for r in component_roots(edges).collect()}
    ids = {x for p in path for x in p}
    assert {got.get(i, i) for i in ids} == {min(ids)} and {got[2000 + i] for i in range(1, 50)} == {2000} and 5000 not in got


def test_cycles_and_strong_components(spark):
    net = graph(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (6, 5), (7, 7)])
    assert sorted(r["members"] for r in paths.cycles(net).collect()) == [[1, 2], [2, 3, 4], [5, 6]]
    assert {r["gid"]: r["scc_id"] for r in paths.strong_components(net).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_time_respecting_paths(spark):
    net = make(spark, [(1, 0), (2, 1), (3, 2), (4, 3)], [(1, 2, 5, 10), (2, 3, 4, 10), (2, 3, 5, 10), (3, 4, 4, 10)])
    reach = lambda **k: {(r["node"], r["day"].day) for r in paths.temporal_reach(net, **k).collect()}
    assert reach() == {(2, 5), (3, 5)} and reach(strict=True) == {(2, 5)}
    assert {r["node"] for r in paths.incompatible_pairs(net).collect()} == {4}
    assert {r["node"] for r in paths.state_reach(net).collect()} == {2, 3}
    assert {r["node"]: r["path"] for r in paths.shortest_witness(net).collect()}[4] == [1, 2, 3, 4]


def test_motifs(spark):
    moved = [(1, 2, 1, 100), (2, 3, 2, 100), (3, 1, 3, 100), (1, 3, 1, 50), *[(4, 5, 6, 70)] * 5, (4, 4, 6, 1)]
    net = make(spark, [(i, 0) for i in range(1, 6)], moved)
    got = {r["gid"]: r for r in motifs.detect(net).collect()}
    assert got[1]["cycle"]["members"] == [1, 2, 3] and got[1]["cycle"]["agreement"] == 1.0 and got[1]["cycle"]["span_days"] == 2
    assert got[4]["motifs"] == ["burst", "repeat_amount"] and got[4]["burst"]["n"] == 6 and got[4]["repeat"]["n"] == 5 and got[4]["leading"] == "burst"
    assert got[5]["burst"]["side"] == "in" and got[5]["burst"]["n"] == 5


def test_communities_find_cliques(spark):
    clique = lambda ids: [(a, b) for a in ids for b in ids if a != b]
    net = graph(spark, clique(range(5)) + clique(range(10, 15)) + [(4, 10)])
    of = communities.communities(net)
    got = {r["gid"]: r["cluster_id"] for r in of.collect()}
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    assert one(communities.modularity(net, of))["modularity"] > 0.4


def test_shuffling_changes_nothing(spark):
    moved = [(i, i + 1, 1 + i % 9, 100 + i) for i in range(69)] + [(i, (i * 7) % 70, 2 + i % 5, 40 + i) for i in range(0, 69, 3)]
    t = tables(spark, [(i, 0 if i % 28 == 0 else min(4, i % 28)) for i in range(70)], moved)
    results = []
    for seed in (7, 91):
        net = as_network(**{k: v.repartition(3).orderBy(F.rand(seed)) for k, v in t.items()})
        rows = roles.prioritise(roles.classify(roles.features(net, communities.communities(net))))
        results.append(sorted(map(str, rows.select("gid", "cluster_id", "role", "role_score", "priority_score", "betweenness").collect())))
    assert results[0] == results[1]


def test_config_is_checked():
    roles.RoleConfig()
    for bad in ({"priority_weights": {"flow": 1.0}}, {"coordinator_centrality_quantile": 1.5}, {"transit_ratio_min": 2.0}, {"max_depth": -1}, {"random_seed": -1}):
        with pytest.raises(ValueError):
            roles.RoleConfig(**bad)
