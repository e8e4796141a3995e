"""Loops to their own end, full depth, configuration, imports and exports."""

from __future__ import annotations

import dataclasses
import json
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import centrality, communities, explore, flows, paths, roles, validate, verify
from flowlens.plans.shared import sums_before
from flowlens.sources import sinks

from .test_network import graph, make, one, tables

LINKS = sorted({(a, b) for a, b in ((random.Random(i).randrange(14), random.Random(i + 999).randrange(14)) for i in range(60)) if a != b})


@pytest.fixture(scope="module")
def dense(spark):
    return graph(spark, LINKS)


def plain_cycles(links, longest):
    out, nodes = set(), sorted({x for p in links for x in p})

    def grow(path):
        for a, b in links:
            if a == path[-1]:
                if b == path[0] and len(path) > 1:
                    out.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < longest:
                    grow([*path, b])

    for n in nodes:
        grow([n])
    return out


def test_cycles_of_up_to_six(dense):
    got = [tuple(r["members"]) for r in paths.cycles(dense).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cycles(LINKS, 6)


def test_wedges_without_pairs(dense):
    row = one(paths.wedges(dense))
    found = [(a, m, b) for a, m in LINKS for m2, b in LINKS if m == m2 and a != b]
    assert (row["wedges"], row["closed"]) == (len(found), sum((a, b) in LINKS for a, _, b in found))


def test_simple_paths_of_four_links(spark):
    net = make(spark, [(0, 0), *[(i, 1) for i in range(1, 7)]], [(i, i + 1, 1, 10) for i in range(6)])
    assert {(r["node"], r["hops"]) for r in paths.simple_paths(net).collect()} == {(i, i) for i in range(1, 5)}


def test_strong_components_end(spark):
    """More components, in rising order of ids, than any fixed number of rounds would do for."""
    links = [x for k in range(0, 16, 2) for x in ((k, k + 1), (k + 1, k), (k + 1, k + 2))]
    got = {r["gid"]: r["scc_id"] for r in paths.strong_components(graph(spark, links)).collect()}
    assert got == {i: i - i % 2 for i in range(16)}


def test_pagerank_settles(spark, dense):
    ids = sorted({x for p in LINKS for x in p})
    rows = {(r["src"], r["dst"]): r["cents"] for r in dense.edges.collect()}
    every = sorted(r["gid"] for r in dense.nodes.collect())
    at = {g: i for i, g in enumerate(every)}
    m = np.zeros((len(every), len(every)))
    for (a, b), c in rows.items():
        m[at[b], at[a]] = c
    total = m.sum(axis=0)
    p = np.ones(len(every)) / len(every)
    for _ in range(400):
        p = 0.85 * (m @ np.divide(p, total, out=np.zeros_like(p), where=total > 0) + p[total == 0].sum() / len(every)) + 0.15 / len(every)
    got = {r["gid"]: r["rank"] for r in centrality.pagerank(dense).collect()}
    assert set(ids) <= set(got) and max(abs(got[g] - p[at[g]]) for g in every) < 1e-13
    single = {r["gid"]: r["rank"] for r in centrality.pagerank(dense, step_rows=0).collect()}
    assert max(abs(single[g] - p[at[g]]) for g in every) < 1e-13
    with pytest.raises(RuntimeError):
        centrality.pagerank(dense, most=8, step_rows=0)


def test_hits_settle(dense):
    every = sorted(r["gid"] for r in dense.nodes.collect())
    at = {g: i for i, g in enumerate(every)}
    m = np.zeros((len(every), len(every)))
    for a, b in LINKS:
        m[at[a], at[b]] = 1
    h = np.ones(len(every))
    for _ in range(4000):
        h = m @ (m.T @ h)
        h /= h.sum()
    a = m.T @ h
    got = {r["gid"]: (r["hub"], r["authority"]) for r in centrality.hits(dense).collect()}
    for g in every:
        assert got[g] == pytest.approx((h[at[g]], a[at[g]] / a.sum()), abs=2e-6)


def test_communities_reach_the_known_optimum(spark):
    """A ring of six cliques of five: the cliques are the optimum; and no single move raises what is returned."""
    clique = lambda ids: [(a, b) for a, b in permutations(ids, 2)]
    links = [x for k in range(6) for x in clique(range(5 * k, 5 * k + 5))] + [(5 * k, (5 * k + 9) % 30) for k in range(6)]
    net = graph(spark, links)
    of = communities.communities(net)
    got = {r["gid"]: r["cluster_id"] for r in of.collect()}
    assert {got[i] for i in range(30)} == set(range(6)) and all(got[i] == got[i - i % 5] for i in range(30))
    w = {}
    for r in communities.projection(net).collect():
        w[r["a"], r["b"]] = w[r["b"], r["a"]] = r["w"]
    two_m = sum(w.values())
    k = {g: sum(v for (a, _), v in w.items() if a == g) for g in got}
    quality = lambda c: sum((w.get((a, b), 0) - k[a] * k[b] / two_m) for a in c for b in c if c[a] == c[b]) / two_m
    top = quality(got)
    assert one(communities.modularity(net, of))["modularity"] == pytest.approx(top)
    for g in (0, 7, 29):
        assert all(quality(got | {g: c}) <= top + 1e-12 for c in range(6))


def test_communities_without_money(spark):
    net = make(spark, [(1, 0), (2, 0)], [(1, 1, 1, 50)])
    assert {r["gid"]: r["cluster_id"] for r in communities.communities(net).collect()} == {1: 0, 2: 1}


def test_running_sums_over_ranges(spark):
    rows = [(i * 37 % 101, i) for i in range(101)]
    got = {r["k"]: (r["before"], r["n"]) for r in sums_before(spark.createDataFrame(rows, "k int, v long").repartition(5), ["k"], before=F.col("v"), n=F.lit(1).cast("long")).collect()}
    v = dict(rows)
    assert got == {k: (sum(v[j] for j in range(k)), k) for k in range(101)}


def test_config_file(spark, tmp_path):
    good = dataclasses.asdict(roles.RoleConfig())
    path = tmp_path / "roles.json"

    def read(**changed):
        path.write_text(json.dumps({k: v for k, v in (good | changed).items() if v is not ...}))
        return roles.read_config(spark, str(path))

    assert read() == roles.RoleConfig() and read(coordinator_centrality_quantile=0, distributor_fan_ratio=3).distributor_fan_ratio == 3
    for bad in (
        {"max_depth": ...}, {"unknown": 1}, {"max_depth": 5}, {"betweenness_samples": 0}, {"louvain_resolution": 0}, {"centrality_mode": "fast"}, {"consolidator_min_payers": 2.5}, {"transit_ratio_min": 1.3}, {"transit_min_matched_fraction": 0},
        {"coordinator_min_degree": True}, {"coordinator_centrality_quantile": 1.01}, {"random_seed": -1}, {"priority_weights": {"flow": 1.0}}, {"priority_weights": {**good["priority_weights"], "flow": 0.5}}, {"transit_ratio_max": "1.2"},
    ):
        with pytest.raises(ValueError):
            read(**bad)
    path.write_text("[1]")
    with pytest.raises(ValueError):
        roles.read_config(spark, str(path))


def test_thresholds_are_rounded():
    made = roles.threshold_scenarios()
    assert (made["relaxed"].coordinator_min_seeds, made["strict"].coordinator_min_seeds, made["relaxed"].consolidator_min_seeds) == (2, 4, 1)
    assert made["strict"].transit_ratio_max == pytest.approx(1.16) and made["relaxed"].distributor_fan_ratio == pytest.approx(1.6)


def test_sensitivity(spark):
    net = make(spark, [(i, 0 if i < 3 else min(4, i // 3)) for i in range(14)], [(a, b, 1 + (a + b) % 5, 10 + a) for a, b in LINKS])
    made = roles.compared(roles.sensitivity(net, seeds=(0,), resolutions=(0.8,))).collect()
    names = {r["scenario"] for r in made}
    assert {"base", "relaxed", "strict", "betweenness_seed_0", "resolution_0.8", "weight flow x 0.8"} <= names and len(names) == 15
    base = next(r for r in made if r["scenario"] == "base")
    assert (base["role_changes"], base["top20"], base["top20_changes"]) == (0, 14, 0)


def test_mixed_offsets_are_counted(spark):
    t = tables(spark, [(1, 0), (2, 1)], [(1, 2, 1, 10), (1, 2, 2, 10)])
    stamped = lambda ends: t | {"transactions": spark.createDataFrame([(1, 2, f"2026-07-0{i + 1}{e}", 10.0) for i, e in enumerate(ends)], "src long, dst long, date string, sum_kzt double")}
    n = lambda ends: {r["check"]: r["violations"] for r in validate.violations(**stamped(ends)).collect()}["tx_zones"]
    assert (n(["", ""]), n(["T10:00:00Z", "T10:00:00Z"]), n(["T10:00:00+05:00", "T10:00:00Z"]), n(["", "T01:00:00+0500"])) == (0, 0, 1, 1)


def test_records_are_checked(spark):
    lines = ['{"gid": 100000000000000001, "role": "transit", "role_score": 0.5}', '{"gid": "7", "date": "2026-02-30", "n_tx": 1.5}', '{"role": "boss"}', "[1]", '{"gid": "x1", "priority_score": 2, "in_cents": -1}', '{"gid": "8", "in_cents": "many"}']
    rows = explore.normalised(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert rows[0]["record"]["gid"] == "100000000000000001" and rows[0]["faults"] == [] and rows[0]["record"]["in_cents"] is None
    assert [set(r["faults"]) for r in rows[1:]] == [{"date", "n_tx"}, {"gid", "role"}, {"json", "gid"}, {"gid", "priority_score", "in_cents"}, {"in_cents"}]


def test_list_for_spreadsheets(spark, tmp_path):
    df = spark.createDataFrame([(2, 8, "transit", 0.5, "b"), (1, 7, "peripheral", 0.75, 'say "a"')], "rank int, gid long, role string, priority_score double, why string")
    sinks.write_list(df, str(tmp_path / "list"))
    data = next((tmp_path / "list").glob("part-*")).read_bytes()
    assert data == '﻿rank,gid,role,priority_score,why\r\n"1","7","peripheral","0.75","say ""a"""\r\n"2","8","transit","0.5","b"\r\n'.encode()


def test_export_order_and_run_checks(spark, tmp_path):
    net = make(spark, [(3, 0), (1, 1), (2, 1)], [(3, 1, 2, 10), (3, 2, 1, 10)])
    assert [r["gid"] for r in sinks.canonical(net).nodes.collect()] == [1, 2, 3]
    sinks.write_csv(net.nodes, str(tmp_path / "csv"), order=("gid",))
    lines = [x for f in sorted((tmp_path / "csv").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("gid")]
    assert [x.split(",")[0] for x in lines] == ["1", "2", "3"]
    runs = spark.createDataFrame([(5.3,), (300.0,), (300.5,), (-1.0,), (float("nan"),), (None,)], "total_seconds double")
    assert one(verify.check_run(runs))["violations"] == 4
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string")
    assert {r["path"] for r in verify.changed_files(old, new).collect()} == {"b", "c"}


def test_starter_ratio_and_medians(spark):
    net = make(spark, [(1, 0), (2, 1), (3, 2), (4, 4), (5, 4)], [(1, 2, 1, 100), (2, 2, 1, 100), (2, 3, 2, 50), (2, 4, 2, 30), (2, 5, 2, 10)])
    assert {r["gid"]: r["pass_through"] for r in flows.starter_ratio(net).collect()}[2] == 0.95
    got = {r["place"]: r["in_cents"] for r in flows.boundary_medians(net).collect()}
    assert got == {"boundary": 2000.0, "interior": 5000.0}


def test_changes_among_the_first(spark):
    rows = spark.createDataFrame([(i, float(-i), "a", "b" if i % 2 else "a") for i in range(10)], "gid long, s double, x string, y string")
    assert one(stats.top_changes(rows, "gid", "s", "x", "y", 5))[:] == (5, 2)
