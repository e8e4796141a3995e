"""Mixing sources to target weights by Efraimidis-Spirakis keys.

Each document gets the key -ln(u) / w from a hash u of its id and text and its quality weight w, so that the
smallest keys form a weighted sample without replacement. A source's target in words is met by whole copies
of the source first (epochs), then by its documents in key order: a document is taken if it fits in what is
left of the target, and passed over if not, until next to nothing is left.

The walk along a source is a few prefix sums, not a loop over documents: from one document that does not fit
to the next, those that can still fit are summed in key order. Keys are bucketed by their logarithm: that of an
exponential key has the same bounded density at every weight, so no bucket is hot whatever the weights. Sizes are
summed by bucket with map-side combining, and only the bucket in which a prefix ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowlens.llm.texts import BLANK_CHARS, BLANKS, count_chars, whole
from flowlens.plans.shared import cut, lookup_join, sums_before

#: Buckets for each unit of a key's logarithm, coarse and fine: a fine one holds at most 1 in 44,000 of a source.
COARSE, FINE = 1 << 6, 1 << 14
WEIGHTS = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3
#: The walk ends when this part of the target, or less, is left.
NEAR = 0.002
UNCLEAN = "#*$%&|<>{}[]\\^~=0123456789!"


def word_count(text: Column) -> Column:
    """Words of a text, null as none: the characters left of blank runs turned to single blanks."""
    one = F.trim(F.regexp_replace(whole(text), BLANKS, " "))
    return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.translate(one, " ", "")) + 1).cast("long")


def quality_weight(text: Column) -> Column:
    """A document weight between 0.05 and 1: the share of its characters that are no symbols or digits, squared."""
    t = whole(text)
    n = F.greatest(F.length(F.translate(t, BLANK_CHARS, "")), F.lit(1))
    clean = 1 - count_chars(t, UNCLEAN) / n
    return F.greatest(clean * clean, F.lit(0.05))


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), whole(text))), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame, size: Column, weight: Column) -> DataFrame:
    """Slim rows (doc_id, source, size, h, key): key is the logarithm of -ln(u) / w."""
    u = (F.floor(F.col("h") / 256).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("h"), weight.alias("w"))
    return rows.select("doc_id", "source", "size", "h", (F.log(-F.log(u)) - F.log("w")).alias("key"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... in turn and share the total of
    all sizes; no target exceeds `most` times its source's size, and what is cut is shared by weight among
    the rest until none is above. In the order of size / weight the cut sources come first, so the level
    follows from running sums; exact in the sizes' integers.
    """
    placed = sums_before(sizes, [F.asc_nulls_last("source")], place=F.lit(1).cast("long"))
    w = F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int"))
    rows = placed.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    total = F.broadcast(rows.agg(F.sum("source_size").alias("total"), F.sum("w").alias("weights")))  # one row
    rows = sums_before(rows.withColumn("ratio", F.col("cap") / F.col("w")), ["ratio", F.asc_nulls_last("source")], caps=F.col("cap"), before=F.col("w")).crossJoin(total)
    rows = rows.withColumn("level", (F.col("total") - F.col("caps")) / (F.col("weights") - F.col("before")))
    rows = cut(rows.withColumn("cut", F.col("level") * F.col("w") > F.col("cap")), "levels")
    # levels fall along the order; that of the first source that is not cut holds for all after it
    level = F.broadcast(rows.agg(F.max(F.when(~F.col("cut"), F.col("level"))).alias("shared")))  # one row
    return rows.crossJoin(level).select("source", "source_size", F.when(F.col("cut"), F.col("cap").cast("double")).otherwise(F.col("shared") * F.col("w")).alias("target"))


def _walk(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One prefix of the walk. state: (s, left, near, after) of the sources still walking; the result: (s, left, end) with
    what is left behind the prefix and the first document that is not in it (null: there is none)."""
    same = F.col("source").eqNullSafe(F.col("s"))
    able = lookup_join(rows, state, same, "inner").where((F.col("size") <= F.col("left")) & (F.col("after").isNull() | (F.col("pos") > F.col("after"))))
    fine = cut(able.groupBy("s", "c", "f").agg(F.sum("size").alias("size")), "mixsums")

    def ends(sums: DataFrame, digit: str) -> DataFrame:
        """Of each source, the bucket in which the prefix ends, and the words before it."""
        so_far = Window.partitionBy("s").orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0)) + F.col("base"))
        over = sums.join(state.select("s", "left", "near").withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).where(F.col("before") + F.col("size") > F.col("left") - F.col("near"))
        return over.groupBy("s").agg(F.min(F.struct(digit, "before")).alias("e"))

    coarse = ends(fine.groupBy("s", "c").agg(F.sum("size").alias("size")).withColumn("base", F.lit(0).cast("long")), "c")
    within = fine.join(coarse.select(F.col("s").alias("t"), F.col("e.c").alias("ec"), F.col("e.before").alias("base")), F.col("s").eqNullSafe(F.col("t")) & (F.col("c") == F.col("ec"))).drop("t")
    last = cut(ends(within, "f").select(F.col("s").alias("t"), F.col("e.f").alias("ef"), F.col("e.before").alias("base")), "mixends")
    inside = Window.partitionBy("s").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # one fine bucket of a source
    tail = lookup_join(able, last, F.col("s").eqNullSafe(F.col("t")) & (F.col("f") == F.col("ef")), "inner")
    tail = tail.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("base"))
    stops = (F.col("before") + F.col("size") > F.col("left")) | (F.col("left") - F.col("before") <= F.col("near"))
    border = F.struct(((F.col("f") + 1) / FINE).alias("key"), F.lit(-(1 << 63)).alias("h"), F.lit(-(1 << 63)).alias("uid"))  # behind the bucket; FINE is a power of two
    ended = tail.groupBy("s").agg(F.coalesce(F.min(F.when(stops, F.struct("pos", "before"))), F.max(F.struct(border.alias("pos"), (F.col("before") + F.col("size")).alias("before")))).alias("e"))
    taken = fine.groupBy("s").agg(F.sum("size").alias("taken"))
    found = taken.join(ended.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select(F.col("s").alias("t"), F.coalesce("e.before", "taken").alias("gone"), F.col("e.pos").alias("end"))
    return state.join(found, F.col("s").eqNullSafe(F.col("t")), "left").select("s", (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left"), "end")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, near: float = NEAR) -> DataFrame:
    """(doc_id, h, size, source_size, target, copies, taken) of every document.

    copies: how often the mix takes the document; taken = copies * size. Deterministic: keys are hashes of id
    and text, so equal rows have equal keys and are exchangeable. Null and empty texts have size 0 and copies
    as their place in key order says; a source without words has target 0. If more than `near` of a target is left when
    nothing fits any more, the first document left in key order that is less than twice what is left is taken too.
    Narrow passes over slim rows, small aggregations, one sort of the bucket in which each prefix ends.
    """
    rows = _keyed(docs, word_count(F.col("text")), quality_weight(F.col("text"))).withColumn("uid", F.monotonically_increasing_id())  # tells equal rows apart
    digit = lambda n: F.floor(F.col("key") * n)
    rows = cut(rows.select("doc_id", "source", "size", "h", F.struct("key", "h", "uid").alias("pos"), digit(COARSE).alias("c"), digit(FINE).alias("f")), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(cut(sizes, "sizes"), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("int")
    plan = cut(targets.withColumn("epochs", epochs).select(F.col("source").alias("s"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")), "mixplan")
    where = dict(rows.dtypes)["pos"]
    state = plan.select("s", F.col("rest").alias("left"), (F.col("target") * near).alias("near"), F.lit(None).cast(where).alias("after"))
    state = cut(state.where("left > near"), "mixstate")
    parts, ended = [], None
    while not state.isEmpty():
        step = _walk(rows, state).withColumnsRenamed({"s": "t", "left": "rest_left"})
        made = cut(state.join(step, F.col("s").eqNullSafe(F.col("t"))).drop("t"), "mixstep")
        parts.append(made.select("s", F.struct("left", "after", "end").alias("part")))
        over = made.where(F.col("end").isNull() | (F.col("rest_left") <= F.col("near"))).select("s", F.col("rest_left").alias("left"), "near")
        ended = over if ended is None else ended.unionByName(over)
        state = made.where(F.col("end").isNotNull() & (F.col("rest_left") > F.col("near"))).select("s", F.col("rest_left").alias("left"), "near", F.col("end").alias("after"))
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        walked = every.groupBy("s").agg(F.collect_list("part").alias("parts"))  # a part for each document that did not fit
        plan = plan.join(walked.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    else:
        plan = plan.withColumn("parts", F.lit(None).cast(f"array<struct<left:double,after:{where},end:{where}>>"))
    marked = lookup_join(rows, cut(plan, "mixparts"), F.col("source").eqNullSafe(F.col("s")))
    in_part = lambda p: (F.col("size") <= p["left"]) & (p["after"].isNull() | (F.col("pos") > p["after"])) & (p["end"].isNull() | (F.col("pos") < p["end"]))
    extra = F.coalesce(F.exists("parts", in_part), F.lit(False)).cast("int")
    chosen = cut(marked.select("doc_id", "h", "size", "source", "pos", "source_size", "target", "epochs", extra.alias("extra")), "mixed")
    if ended is not None:
        gaps = cut(ended.where("left > near").select("s", "left"), "mixgaps")
        able = lookup_join(chosen.where("extra = 0"), gaps, F.col("source").eqNullSafe(F.col("s")), "inner").where(F.col("size") < 2 * F.col("left"))
        closing = cut(able.groupBy("s").agg(F.min("pos").alias("closing")), "mixclosing")
        chosen = lookup_join(chosen, closing, F.col("source").eqNullSafe(F.col("s"))).withColumn("extra", F.greatest("extra", F.coalesce((F.col("pos") == F.col("closing")).cast("int"), F.lit(0))))
    copies = (F.col("epochs") + F.col("extra")).cast("int")
    return chosen.select("doc_id", "h", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """docs with each row repeated as often as mix takes it, and left out where it takes none.

    Rows are matched by id and text hash. Of rows equal in both, copies
    are dealt in turn by the hash of the whole row. The columns are those of docs, whatever their names.
    """
    taken = mix(docs, weights, most).groupBy("doc_id", "h").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    packed = docs.select(row, docs["doc_id"].alias("_id"), _hash(docs["doc_id"], docs["text"]).alias("_h"))
    wanted = packed.join(taken, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")))
    several = wanted.where("_rows > 1")
    turn = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.xxhash64("_row")))
    share = (F.floor(F.col("_copies") / F.col("_rows")) + (turn <= F.pmod("_copies", "_rows")).cast("int")).cast("int")
    dealt = wanted.where("_rows = 1").select("_row", F.col("_copies").cast("int").alias("_n")).unionByName(several.select("_row", share.alias("_n")).where("_n > 0"))
    return dealt.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
