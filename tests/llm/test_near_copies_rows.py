"""Near-dedup judges rows, not ids."""

from __future__ import annotations

from flowlens.llm import simhash

from .conftest import SCHEMA, prose


def test_texts_that_share_an_id_are_judged_apart(spark):
    a, b, c = prose(50, 90), prose(51, 90), prose(52, 90)
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (2, c), (None, a), (None, None), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, c), (None, a), (None, None), (3, None)], key=str)


def test_rows_of_one_text_give_the_same_row_each_time(spark):
    """Of rows equal in id and text but not in source the same one stays, however they are dealt; rows without an id stay."""
    rows = [(1, prose(1, 60), "en", s, 1) for s in "fedcba"] + [(2, prose(1, 60), "en", "z", 1), (None, prose(2, 60), "en", "a", 1), (None, prose(2, 60), "en", "a", 1)]
    kept = []
    for k in (1, 2, 5):
        docs = spark.createDataFrame(rows[::-1] if k == 2 else rows, SCHEMA).repartition(k)
        kept.append(sorted((str(r["doc_id"]), r["source"]) for r in simhash.drop_near_copies(docs).collect()))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3


def test_dropping_without_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == [1, 3]
