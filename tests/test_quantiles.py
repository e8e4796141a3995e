"""Exact quantiles against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlens.functions.quantiles import exact_quantiles

POINTS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


def test_quantiles_by_group(spark):
    r = np.random.default_rng(1)
    data = [("a", float(x)) for x in r.normal(size=501)] + [("b", float(x)) for x in r.integers(0, 4, 300)] + [("c", 7.0)] * 200 + [("d", 1.5)] + [("e", None)] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    got = {(x["g"], x["p"]): (x["n"], x["value"]) for x in exact_quantiles(df, "v", POINTS, ("g",)).collect()}
    for g in "abcd":
        values = np.array([v for k, v in data if k == g and v is not None])
        for p in POINTS:
            n, value = got.pop((g, p))
            assert n == len(values) and abs(value - np.quantile(values, p)) < 1e-12
    assert not got


def test_quantiles_of_all_and_none(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert {x["p"]: x["value"] for x in exact_quantiles(df, "v", (0.5, 0.333)).collect()} == {0.5: 499.5, 0.333: 0.333 * 999}
    assert exact_quantiles(df.where("false"), "v", (0.5,)).count() == 0


def test_no_task_sees_all_values(spark):
    """The plan has no aggregate without a key over the values."""
    df = spark.range(1000).select(F.col("id").alias("v"))
    plan = exact_quantiles(df, "v", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan
