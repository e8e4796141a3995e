"""Best cycles found level by level are those of all cycles, from fewer rows."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators import motifs, paths
from flowlens.sources.fixture import network

from .test_network import make


def of_all(net, longest=6):
    each = motifs.described_cycles(net, longest).withColumn("names", F.transform("members", lambda m: m.cast("string"))).select("*", F.explode("members").alias("gid"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("agreement"), "span_days", "length", "names"))
    return sorted(map(str, each.withColumn("r", rank).where("r = 1").drop("r", "names").select("gid", "members", "length", "agreement", "span_days", "first_day", "last_day", "legs").collect()))


@pytest.mark.parametrize(("seed", "levels"), [(1, motifs.LEVELS), (2, (1.0, 0.0)), (3, (0.9, 0.3, 0.0))])
def test_best_of_levels_is_best_of_all(spark, seed, levels):
    r = random.Random(seed)
    moved = [(r.randrange(12), r.randrange(12), r.randrange(1, 20), r.choice([100, 100, 150, 300, 970])) for _ in range(45)]
    net = make(spark, [(g, g % 5) for g in range(12)], moved)
    got = motifs.best_cycles(net, levels=levels).select("gid", "members", "length", "agreement", "span_days", "first_day", "last_day", "legs")
    assert sorted(map(str, got.collect())) == of_all(net)


DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_fewer_cycles_are_made(spark, monkeypatch):
    net, made = network(spark, str(DATA)), []
    real = motifs.described
    monkeypatch.setattr(motifs, "described", lambda found, first: (made.append(found.count()), real(found, first))[1])
    assert motifs.best_cycles(net).count() == motifs.described_cycles(net).select(F.explode("members").alias("g")).distinct().count()
    assert sum(made[:-1]) < paths.cycles(net).count()
