"""Documents with nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "size int, score double, kept boolean, level int, h long, fp long, row long, b int, _row int, _text string, stratum string, spans string, uid long, g long, x double, quality int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = "alpha beta gamma delta river stone house garden window paper light music engine table cloud forest bridge letter".split()
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def rows() -> list[tuple]:
    out = [(i, prose(i, 60 + 5 * i), ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None) for i in range(12)]
    out += [(20, prose(3, 75), "en", "a", 1), (21, prose(3, 75) + " more", "en", "a", 2), (21, prose(3, 75) + " more", "en", "a", 2)]
    out += [(30, None, "en", "a", 0), (31, "", None, None, 0), (32, " \n\t ", "de", "b", 4), (33, "word", "en", "b", 4), (None, prose(5, 80), "en", "a", 9), (None, None, None, None, None)]
    out += [(40, prose(9, 30_000), "en", "b", None), (41, "x" * 200_000, "en", "c", None), (42, "A-Z éß中文 \U0001f600 " * 20, "de", "c", None)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward documents, with clashing columns, in several partitions."""
    base = spark.createDataFrame(rows(), SCHEMA)
    from pyspark.sql import functions as F

    return base.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHES.split(", ")]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    made = [(i, i % 2, 0) for i in range(12)] + [(3, 1, 0), (3, 1, 0), (5, 0, 0), (None, 1, 0), (40, None, None)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tables(odd, labels, tmp_path_factory):
    """A folder with the tables that queries and the pipeline read."""
    path = tmp_path_factory.mktemp("tables")
    odd.write.parquet(str(path / "documents.parquet"))
    labels.write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="session")
def empty_tables(none, labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    none.write.parquet(str(path / "documents.parquet"))
    labels.where("false").write.parquet(str(path / "labels.parquet"))
    return str(path)
