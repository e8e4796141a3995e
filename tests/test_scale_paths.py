"""Rounds and rows of reach, strong components and as-of lags at awkward shapes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import fifo, paths

from .test_network import make


def links_only(spark, pairs, nodes=None):
    """A network of links of one cent-sum each; depth 0 for the first node."""
    ids = sorted({g for p in pairs for g in p} | set(nodes or ()))
    return make(spark, [(g, 0 if i == 0 else 1 + i % 4) for i, g in enumerate(ids)], [(a, b, 1, 100) for a, b in pairs])


def plain_scc(pairs):
    """{gid: least gid} of nodes on a cycle, by reach in both directions."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for g in {x for p in pairs for x in p}:
        seen, todo = set(), [g]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[g] = seen
    groups = {g: {h for h in reach[g] if g in reach[h]} for g in reach}
    return {g: min(x | {g}) for g, x in groups.items() if len(x | {g}) > 1}


def found(net):
    return {r["gid"]: r["scc_id"] for r in paths.strong_components(net).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 14
    pairs = sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(11 + 4 * seed)) if a != b})
    chain = [(100 * seed + 50 + i, 100 * seed + 51 + i) for i in range(7)]
    pairs += [(pairs[0][0], chain[0][0]), *chain, (chain[-1][1], r.randrange(n))]  # a long way round
    pairs = sorted({p for p in pairs if p[0] != p[1]})
    assert found(links_only(spark, pairs)) == plain_scc(pairs)


def test_rings_tails_and_loops_through_chains(spark):
    ring = [(10 + i, 10 + (i + 1) % 6) for i in range(6)]
    petals = [(30, 31), (31, 32), (32, 30), (30, 41), (41, 42), (42, 30)]
    tails = [(1, 10), (2, 1), (15, 50), (50, 51), (60, 61), (61, 62)]
    two = [(70, 71), (71, 70)]
    pairs = ring + petals + tails + two
    want = plain_scc(pairs)
    assert want[15] == 10 and want[42] == 30 and want[71] == 70 and 50 not in want
    assert found(links_only(spark, pairs)) == want


@pytest.mark.parametrize("closed", [False, True])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, closed):
    """10,000 links: tables written stay under 30 a direction, whether the chain ends or is a ring."""
    n, written = 10_000, []
    real = paths.cut_and_sum
    monkeypatch.setattr(paths, "cut_and_sum", lambda df, label, **k: (written.append(label), real(df, label, **k))[1])
    rows = spark.range(n + (0 if closed else 1)).select(F.col("id").alias("gid"), F.lit(1).alias("depth"), F.lit(False).alias("is_seed"))
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % (n if closed else n + 1)).alias("dst"), F.lit(1.0).alias("sum_kzt"), F.lit(1).alias("n_tx"), F.lit(1).alias("depth"))
    net = paths.Network(rows, edges.withColumn("cents", F.lit(100).cast("long")), edges)
    got = paths.strong_components(net)
    assert (got.count(), got.agg(F.max("scc_id")).first()[0]) == ((n, 0) if closed else (0, None))
    assert written.count("chains") <= 2 * 16 and len(written) - written.count("chains") < 10


def test_seed_bits_are_walks(spark):
    """The same pairs as by (seed, node) rows, over several words of seeds; rows stay below nodes times words."""
    r = random.Random(3)
    n = 150
    moved = [(a, b, 1, 100) for a, b in {(r.randrange(n), r.randrange(n)) for _ in range(300)}] + [(g, 0, 1, 100) for g in range(1, 140)]  # node 0 is a hub
    net = make(spark, [(g, 0 if g % 2 else 1 + g % 4) for g in range(n)], moved)
    for most in (1, 3, 4):
        bits = paths.seed_bits(net, most).collect()
        order = sorted(g for g in range(n) if g % 2)
        pairs = {(order[64 * x["block"] + k], x["gid"]) for x in bits for k in range(64) if x["bits"] >> k & 1}
        assert pairs == {tuple(x) for x in paths.walk(net.links, paths.seeds(net), most).select("seed", "node").collect()}
        assert len(bits) <= n * 2
    counts = {x["gid"]: x["seed_reach"] for x in paths.seed_reach(net).collect()}
    assert counts == {g: len({s for s, v in pairs if v == g and s != g}) for g in range(n)}


def test_lags_are_nearest_days(spark):
    r = random.Random(4)
    moved = [(r.randrange(6), r.randrange(6), r.randrange(1, 30), 10 * r.randrange(1, 9)) for _ in range(120)]
    net = make(spark, [(g, g % 5) for g in range(6)], moved)
    outs = {}
    for a, b, d, _ in moved:
        if a != b:
            outs.setdefault(a, set()).add(d)
    lags = [(min((d2 - d for d2 in outs.get(b, ()) if d2 >= d), default=None), 100 * x) for a, b, d, x in moved if a != b]
    want = {(k, sum(1 for g, _ in lags if k is None or (g is not None and g <= k)), sum(x for g, x in lags if k is None or (g is not None and g <= k))) for k in (0, 1, 2, 7, None)}
    assert {tuple(x) for x in fifo.next_outgoing(net).collect()} == want
