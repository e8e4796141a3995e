"""The shared folder, and caches that see a changed table."""

from __future__ import annotations

import types

import pytest

from flowlens.plans.shared import shared_dir, table_version
from flowlens.sources.fixture import network


def fake(master):
    held = {}
    conf = types.SimpleNamespace(get=lambda k, d: held.get(k, d), set=held.__setitem__)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake(master))


def test_one_process_may_use_its_own():
    spark = fake("local[2]")
    assert shared_dir(spark) == shared_dir(spark)


def test_a_changed_table_is_read_again(spark, tmp_path):
    rows = [(u, "purchase", "{\"k\": %d}" % (u * 3 + i), float(30 * i), f"2024-01-0{1 + i % 5} 10:00:00") for u in range(0, 57) for i in range(3)]
    made = spark.createDataFrame(rows, "user_id long, event_type string, props string, value double, ts string").selectExpr("user_id", "event_type", "props", "value", "cast(ts as timestamp) ts")
    path = f"{tmp_path}/events.parquet"
    made.write.parquet(path)
    before, was = table_version(spark, path), network(spark, str(tmp_path)).tx.count()
    made.where("user_id <> 28").write.mode("overwrite").parquet(path)
    assert table_version(spark, path) != before and network(spark, str(tmp_path)).tx.count() < was
