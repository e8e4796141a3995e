"""Steps whose cost must not grow faster than their input: visits, files and rounds are counted, not timed."""

from __future__ import annotations

import random
import threading
from pathlib import Path

import numpy as np
import pytest

from flowlens.operators import centrality, communities, motifs, paths
from flowlens.plans import catalog, shared

from .test_network import make


class Counted(np.ndarray):
    """An array that counts what is taken from it."""

    taken = 0

    def __getitem__(self, at):
        got = np.asarray(self)[at]
        Counted.taken += got.size
        return got


def graph(spark, n: int, seed: int):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(3 * n)}
    return make(spark, [(g, g % 5) for g in range(n)], [(a, b, 1, 100) for a, b in sorted(pairs) if a != b])


def test_a_source_visits_each_link_once():
    n = 400
    first = np.append(np.arange(n), n - 1)  # a chain, as many levels as nodes
    to = np.arange(1, n).view(Counted)
    Counted.taken = 0
    got, squares = centrality.dependencies(np.array([0, 100]), first, to, n)
    assert Counted.taken == (n - 1) + (n - 1 - 100)
    own = lambda s: np.array([n - 1 - v if v > s else 0 for v in range(n)], float)
    assert (got == own(0) + own(100)).all() and (squares == own(0) ** 2 + own(100) ** 2).all()


def test_walks_by_joins_go_in_batches_and_leave_no_files(spark, monkeypatch):
    net = graph(spark, 40, 1)
    whole = {r["gid"]: r["betweenness"] for r in centrality.betweenness(net).collect()}
    monkeypatch.setattr(centrality, "PAIRS_AT_ONCE", 600)
    folder = Path(shared.shared_dir(spark)) / "flowlens"
    before = {p.name for p in folder.iterdir()}
    found = {r["gid"]: r["betweenness"] for r in centrality.betweenness(net, small_links=0).collect()}
    assert found == pytest.approx(whole, abs=2e-9)
    left = [p.name.split("-")[0] for p in folder.iterdir() if p.name not in before]
    assert sorted(left) == ["dependencies"] * 3 + ["links"]


@pytest.mark.parametrize("query", ["auc", "adjusted_rand", "kpis", "table_page"])
def test_sums_of_nodes_need_no_betweenness(spark, monkeypatch, query):
    def never(*_, **__):
        raise AssertionError("betweenness")

    monkeypatch.setattr(centrality, "betweenness", never)
    monkeypatch.setattr("flowlens.operators.roles.betweenness", never)
    monkeypatch.setattr(catalog, "_KEPT", {})
    assert catalog.queries()[query](spark, "/root/testdata/sf0.01").count() > 0


def test_hits_take_few_steps(spark):
    """Two dense groups of nearly the same weight: power iteration moves by 1e-13 after over 200 steps only."""
    group = lambda at, n: [(at + i, at + j, 1, 100) for i in range(n) for j in range(n) if i != j]
    rows = group(0, 12)[:-1] + group(20, 12)[:-7] + [(0, 20, 1, 100)]
    net = make(spark, [(g, g % 5) for g in range(32) if not 12 <= g < 20], rows)
    m = np.zeros((32, 32))
    for a, b, *_ in rows:
        m[a, b] = 1
    values, vectors = np.linalg.eigh(m @ m.T)
    assert np.log(1e-13) / np.log(values[-2] / values[-1]) > 200
    h = np.abs(vectors[:, -1])
    a = m.T @ h
    found = {r["gid"]: (r["hub"], r["authority"]) for r in centrality.hits(net, most=64).collect()}
    assert all(found[g] == pytest.approx((h[g] / h.sum(), a[g] / a.sum()), abs=2e-6) for g in found)


def removal(nodes, pairs, v):
    """(components, largest) of the rest, by a plain search."""
    near = {g: set() for g in nodes if g != v}
    for a, b in pairs:
        if v not in (a, b) and a != b:
            near[a].add(b)
            near[b].add(a)
    sizes, open_ = [], set(near)
    while open_:
        todo, n = [open_.pop()], 0
        while todo:
            n += 1
            for u in near[todo.pop()] & open_:
                open_.discard(u)
                todo.append(u)
        sizes.append(n)
    return (len(sizes), max(sizes)) if sizes else None


@pytest.mark.parametrize(("n", "links", "seed"), [(40, 44, 1), (40, 30, 2), (30, 60, 3), (1, 0, 4)])
def test_removals_as_a_plain_search(spark, n, links, seed):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(n), r.randrange(n)) for _ in range(links)})
    net = make(spark, [(g, g % 5) for g in range(n)], [(a, b, 1, 100) for a, b in pairs])
    found = {x["removed"]: (x["n_components"], x["largest"]) for x in paths.resilience(net, net.nodes.select("gid")).collect()}
    expected = {v: removal(range(n), pairs, v) for v in range(n)}
    assert found == {v: x for v, x in expected.items() if x}


def test_agreement_rounds_the_exact_product(spark):
    """Halves of a ten-thousandth: as in SQL, where amounts are multiplied before they are divided."""
    rows = spark.createDataFrame([(2 * k + 1, 20000) for k in range(5000)], "low long, high long")
    found = rows.select("low", motifs._agreement(rows["low"], rows["high"]).alias("x")).collect()
    assert all(x["x"] == round(x["low"] / 2) / 10000 for x in found)


def test_a_busy_day_is_named_by_its_date(spark):
    net = make(spark, [(0, 0), (1, 1)], [(0, 1, 3, 100 + i) for i in range(5)])
    days = {str(r["day"]) for r in net.tx.select("day").distinct().collect()}
    assert {r["summary"] for r in motifs.detect(net).collect()} == {f"5 transfers on {d}" for d in days}


@pytest.mark.parametrize("block_links", [250_000, 60])
def test_rounds_broadcast_no_table(spark, monkeypatch, block_links):
    plans = []

    def noted(df, *args, **sums):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.cut_and_sum(df, *args, **sums)

    monkeypatch.setattr(communities, "cut_and_sum", noted)
    monkeypatch.setattr(centrality, "cut_and_sum", noted)
    net = graph(spark, 40, 1)
    try:
        communities.communities(net, block_links=block_links, most=4)
    except communities.Unsettled:
        pass
    centrality.hits(net)
    assert len(plans) > 6 and not any("BroadcastHashJoin" in p for p in plans)


def plain_levels(source, pairs, n):
    """Links from source to each node; n where there is no path."""
    level, here = [n] * n, {source}
    for k in range(n):
        for v in here:
            level[v] = k
        here = {b for a, b in pairs if a in here and level[b] == n}
    return level


@pytest.mark.parametrize(("n", "many", "seed"), [(300, 1200, 1), (60, 70, 2), (40, 400, 3), (5, 3, 4)])
def test_sources_search_together(n, many, seed):
    """64 sources read the links once a round, not once each, and give the sums that each gives by itself."""
    r = random.Random(seed)
    pairs = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(many)) if a != b}
    src, dst = (np.array(x) for x in zip(*sorted(pairs, key=lambda p: p[::-1]), strict=True))
    first, to = np.append(0, np.cumsum(np.bincount(src, minlength=n))), dst[np.argsort(src, kind="stable")]
    sources = np.array(r.sample(range(n), min(n, 64)))
    levels = [plain_levels(s, pairs, n) for s in sources]
    deepest = max(x for one in levels for x in one if x < n)
    assert centrality.levels_together(sources, src, dst, n, deepest) is None
    ahead, digits = centrality.levels_together(sources, src, dst, n, deepest + 1)
    for i, one in enumerate(levels):
        bit = lambda x: ((x >> np.uint64(i)) & np.uint64(1)).astype(int)  # noqa: B023, E731
        assert bit(ahead).tolist() == [one[b] == one[a] + 1 for a, b in zip(src, dst, strict=True)]
        found = sum((bit(x) << j for j, x in enumerate(digits)), np.zeros(n, int))
        assert all(x in (n, y) for x, y in zip(one, found, strict=True))
    own = [centrality.dependencies(np.array([s]), first, to, n) for s in sources]
    together = centrality.dependencies_together(sources, src, dst, n)
    for got, plain, whole in zip(together, zip(*own, strict=True), centrality.dependencies_of(sources, src, dst, n), strict=True):
        assert got == pytest.approx(sum(plain), rel=1e-12) and (got == whole).all()


def test_deep_graphs_go_source_by_source(spark):
    n = 150  # a chain of more levels than sources search together
    net = make(spark, [(g, 0) for g in range(n)], [(g, g + 1, 1, 100) for g in range(n - 1)])
    found = {r["gid"]: r["betweenness"] for r in centrality.betweenness(net).collect()}
    assert found == pytest.approx({v: v * (n - 1 - v) / ((n - 1) * (n - 2)) for v in range(n)}, abs=1e-9)


@pytest.mark.parametrize("chain", [0, 80])
def test_leaves_are_not_searched(monkeypatch, chain):
    """Nodes that pay no one and are paid by one node are in no search, and count all the same; a chain makes the graph deep."""
    r, n = random.Random(6), 60
    core = {(r.randrange(20), r.randrange(20)) for _ in range(50)} | {(20 + i, 21 + i) for i in range(chain)} | ({(3, 20)} if chain else set())
    n = max(n, 21 + chain)
    pairs = {(a, b) for a, b in core if a != b} | {(r.randrange(20), n + i) for i in range(30)}
    n += 30
    src, dst = (np.array(x) for x in zip(*sorted(pairs, key=lambda p: p[::-1]), strict=True))
    first, to = np.append(0, np.cumsum(np.bincount(src, minlength=n))), dst[np.argsort(src, kind="stable")]
    plain = centrality.dependencies(np.unique(src), first, to, n)
    searched, links = [], centrality.Links
    monkeypatch.setattr(centrality, "Links", lambda src, dst, n: searched.append(len(src)) or links(src, dst, n))
    got = centrality.dependencies_of(np.unique(src), src, dst, n)
    assert searched and max(searched) <= len(pairs) - 30
    for a, b in zip(got, plain, strict=True):
        assert a == pytest.approx(b, rel=1e-12)


def test_a_sweep_of_communities_shuffles_few_times(spark, monkeypatch):
    plans = []

    def noted(df, label, **sums):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.cut_and_sum(df, label, **sums)

    monkeypatch.setattr(communities, "cut_and_sum", noted)
    with pytest.raises(communities.Unsettled):
        communities.communities(graph(spark, 40, 1), block_links=30, most=1)
    sweeps = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert sweeps and max(p.count("Exchange hashpartitioning") for p in sweeps) <= 12


def test_resolutions_are_searched_at_the_same_time(spark, monkeypatch):
    net = graph(spark, 20, 1)
    made = net.nodes.selectExpr("gid", "gid div 5 AS cluster_id")
    together, tried = threading.Barrier(3, timeout=20), []

    def found(_, resolution=1.0):
        together.wait()
        tried.append(resolution)
        return made

    monkeypatch.setattr(communities, "communities", found)
    assert [(r["resolution"], r["rand"]) for r in catalog._resolutions(net).collect()] == [(0.8, 1.0), (1.2, 1.0)]
    assert sorted(tried) == [0.8, 1.0, 1.2]


def test_nodes_of_two_blocks_do_not_change_places(spark):
    """Pairs whose nodes lie in different blocks: in a one-way sweep one of them moves to the other, so none swap."""
    pairs = [(2 * i, 2 * i + 1) for i in range(40)]
    both = spark.createDataFrame([(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], "a long, b long, w double")
    place = spark.createDataFrame([(g, 1.0, g) for p in pairs for g in p], "gid long, k double, c long")
    made, moves = communities._sweep(both, place, 5, 16, 0, 1 / 80, True)
    at = {r["gid"]: r["c"] for r in made.collect()}
    assert moves == 40 and all(at[a] == at[b] for a, b in pairs)
