"""Betweenness by progressive sampling: the stated error holds, and rounds end when it does."""

from __future__ import annotations

import random

import pytest

from flowlens.operators import centrality, roles

from .test_network import make


def ladder(spark, n: int, seed: int):
    """Hubs in a row with many leaves, and some chords."""
    r = random.Random(seed)
    pairs = {(i, i // 7) for i in range(1, n)} | {(i // 7, i) for i in range(1, n, 3)} | {(r.randrange(n), r.randrange(n)) for _ in range(n // 4)}
    return make(spark, [(g, g % 5) for g in range(n)], [(a, b, 1, 100) for a, b in sorted(pairs) if a != b])


@pytest.mark.parametrize("small_links", [centrality.SMALL_LINKS, 0])
def test_the_error_holds(spark, small_links):
    net = ladder(spark, 300 if small_links else 160, 1)
    exact = {r["gid"]: r["betweenness"] for r in centrality.betweenness(net).collect()}
    for error in (0.5, 0.3) if small_links else (0.5,):
        got = centrality.betweenness_within(net, error, small_links=small_links).collect()
        assert len(got) == len(exact) and max(r["error"] for r in got) <= error
        assert all(abs(r["betweenness"] - exact[r["gid"]]) <= r["error"] + 1e-9 for r in got)
        assert {r["samples"] for r in got} < {64, 128, 256}  # not all sources were needed


def test_all_sources_are_exact(spark):
    net = ladder(spark, 90, 2)
    got = {r["gid"]: (r["betweenness"], r["error"], r["samples"]) for r in centrality.betweenness_within(net, 1e-6).collect()}
    assert got == {r["gid"]: (pytest.approx(r["betweenness"], abs=2e-9), 0.0, 90) for r in centrality.betweenness(net).collect()}


def test_exact_mode_refuses_what_it_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(centrality, "MOST_PAIRS", 100)
    net = ladder(spark, 30, 3)
    with pytest.raises(ValueError, match="betweenness_within"):
        centrality.betweenness(net, small_links=0)
    assert centrality.betweenness(net).count() == 30 == centrality.betweenness(net, 5, small_links=0).count()


def test_isolates_and_few_nodes(spark):
    assert centrality.betweenness_within(make(spark, [(1, 0), (2, 1)], [(1, 2, 1, 5)])).count() == 2
    net = ladder(spark, 40, 4)
    rows = roles.simple_rankings(roles.prioritise(roles.classify(roles.features(net, net.nodes.selectExpr("gid", "gid div 10 AS cluster_id"))))).collect()
    assert len(rows) == 12 and all(r["shared"] == 40 for r in rows if r["k"] == 50)
