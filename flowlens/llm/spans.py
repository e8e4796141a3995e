"""Places of regular-expression matches, by column functions alone.

Arrays never grow inside a fold, which would copy them at each step: sums and maxima run along an array by
doubling, so a text with n matches takes n log n steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.plans.shared import let

SPAN = "struct<start:int,end:int,kind:int,hit:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array of op over each value and all before it; op is associative. Round k reaches back over 2**k values."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.greatest(F.size(values) - 1, F.lit(0)))) - 1)

    def step(a: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= far, op(F.get(a, i - far), x)).otherwise(x))

    return let(values, lambda v: F.aggregate(rounds, v, step))


def plus(a: Column, b: Column) -> Column:
    return a + b


def match_spans(text: Column, pattern: str | Column, kind: int) -> Column:
    """array<struct<start, end, kind, hit>> of the leftmost matches that do not overlap, in code points from 0.

    The gaps between matches are what split() leaves; running sums of gap and match lengths give the places. The
    pattern must not match the empty string.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["gaps"], 1, F.size(s["hits"])), s["hits"], lambda g, h: F.length(g) + F.length(h))
        return F.zip_with(running(steps, plus), s["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), h.alias("hit")))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")), placed)


def merged(spans: Column) -> Column:
    """Union of spans sorted by start, as array<struct<start, end>> without overlaps; spans that touch are one."""

    def islands(s: Column) -> Column:
        tops = s["tops"]
        starts = F.filter(F.transform(s["spans"], lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), (x["start"] > F.coalesce(F.get(tops, i - 1), F.lit(-1))).alias("new"))), lambda x: x["new"])
        last = lambda all_, j: F.coalesce(F.get(all_, j + 1)["i"], F.size(tops)) - 1
        return let(starts, lambda all_: F.transform(all_, lambda x, j: F.struct(x["start"].alias("start"), F.get(tops, last(all_, j)).alias("end"))))

    return let(F.struct(spans.alias("spans"), running(F.transform(spans, lambda x: x["end"]), F.greatest).alias("tops")), islands)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with each of the merged spans replaced by mark.

    Pieces are taken from the text in UTF-32, where a place is an offset and no piece is looked for from the start.
    """

    def pieces(wide: Column) -> Column:
        def piece(_: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
            end = F.coalesce(F.get(spans, i)["start"], F.length(wide) / 4).cast("int")
            # a letter goes before each piece, so that none starts with what decoding takes for a byte order mark
            return F.substring(F.decode(F.concat(F.lit(b"\0\0\0x"), F.substring(wide, begin * 4 + 1, (end - begin) * 4)), "UTF-32"), F.lit(2), end - begin)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), mark)

    return let(F.encode(text, "UTF-32"), pieces)
