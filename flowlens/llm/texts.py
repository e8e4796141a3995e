"""Word rules and row defaults shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a regular expression: space and the control characters 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(whole(text), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def by_text(docs: DataFrame, of: Callable[[list], tuple[dict[str, pa.Array], list[int] | None]], schema: str, doc_id: str = "doc_id", text: str = "text", carried: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, carried..., columns of `schema`): what `of` makes of the texts of each Arrow batch, in one narrow pass.

    of takes a list of texts (None for null) and returns its columns and how many rows each text has among them
    (None: one each). Ids and carried columns stay in Arrow, so a long beside a null is still that long.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(name) for name, c in (carried or {}).items()], F.col(text).alias("_text"))
    own = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, counts = of(b.column(len(own)).to_pylist())
            kept = [b.column(i) for i in range(len(own))]
            if counts is not None:
                at = pa.array(np.repeat(np.arange(len(counts)), counts))
                kept = [c.take(at) for c in kept]
            yield pa.RecordBatch.from_arrays([*kept, *made.values()], [*own, *made])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes[:-1]), schema]))
