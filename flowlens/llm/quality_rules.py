"""Quality rules with risk-controlled cutoffs.

Every text gets countable statistics by column functions alone. Labelled documents, of equal ones one, then choose, for each
stratum, the strictest level of cutoffs whose share of falsely rejected good documents is at most a stated
risk: the hypothesis "the risk is above the bound" is tested with the exact binomial tail at each level of a
fixed ladder, from the loosest on, until one test fails (a fixed sequence needs no correction), and the
sequences of all strata share the error by Bonferroni's rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowlens.llm.texts import BLANK_CHARS, UPPER, count_chars, whole, words
from flowlens.plans.shared import cut, let, lookup_join

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")

#: Rules: a rate in which high is bad, and its cutoffs by level, from the loosest to the strictest.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.37, 0.35)),
    "capitals": ("n_upper / greatest(word_chars, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "bangs": ("n_bangs / greatest(n_words, 1)", (1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3)),
}
LEVELS = 8


def _repeat_words(found: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; found: the array of words.

    Windows are sorted by a 64-bit hash with their place, so equal ones are neighbours; the places of those
    are sorted again and their three words each counted once.
    """
    hashes = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.struct(F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).cast("long").alias("n"))
    covered = F.aggregate(let(hashes, places), start, step, lambda a: a["n"])
    return F.when(F.size(found) >= 4, covered).otherwise(F.lit(0).cast("long"))


def rule_stats(text: Column) -> Column:
    """Struct of the statistics named in STATS, all long; null counts as empty. Whole texts, no UDF."""
    text = whole(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    made = {
        "n_words": "w.n", "word_chars": F.length(F.translate(text, BLANK_CHARS, "")), "n_symbols": count_chars(text, SYMBOLS),
        "n_dup_lines": "l.d", "n_repeat_words": "w.r", "n_lines": "l.n", "n_upper": count_chars(text, UPPER), "n_bangs": count_chars(text, "!"),
    }
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(*[(s[v[0]][v[2]] if isinstance(v, str) else v.cast("long")).alias(k) for k, v in made.items()]),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (n_repeat_words * 100 > n_words * 50)


def _tail(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k), summed in logarithms."""
    odds = F.log(F.lit(risk / (1 - risk)))
    first = n * F.log(F.lit(1 - risk))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["s"])


def severity() -> Column:
    """The loosest level at which any rule rejects a row with the STATS columns; LEVELS if none does."""
    first = lambda rate, ladder: F.lit(LEVELS) - sum((F.expr(rate) >= F.lit(c)).cast("int") for c in ladder)
    return F.least(*[first(rate, ladder) for rate, ladder in RULES.values()])


def fit_cutoffs(labelled: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, level) from rows (stratum, quality, the STATS columns): all rules' cutoffs, as a level of RULES.

    Only rows labelled 1 that pass the base rule count: rejecting one of those is a false rejection. In each
    stratum at most `risk` of them are rejected at the level, with probability 1 - `error` over all strata
    together. A stratum without enough labels (59 at these defaults, more with several strata) gets no level
    and rejects nothing. One row per stratum and level leaves each scan task.
    """
    good = labelled.where((F.col("quality") == 1) & ~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    counts = good.groupBy("stratum", severity().alias("level")).count()
    at = counts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("level", "count"))).alias("at"), F.sum("count").alias("n"))
    strata = at.agg(F.count("*").alias("strata"))
    at = at.crossJoin(F.broadcast(strata))  # one row: a total
    tests = at.select("stratum", "strata", "n", "at", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    k = F.aggregate(F.map_entries("at"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] <= F.col("level"), e["value"]).otherwise(F.lit(0)))
    tests = tests.withColumn("k", k)
    p = F.when(F.col("k") <= F.col("n") * risk, _tail(F.col("n"), F.col("k"), risk)).otherwise(F.lit(1.0))
    along = Window.partitionBy("stratum").orderBy("level")  # LEVELS rows
    tests = tests.withColumn("bad", F.max((p * F.col("strata") > error).cast("int")).over(along))
    return tests.where("bad = 0").groupBy("stratum").agg(F.max("level").alias("level"))


def rejected() -> Column:
    """Whether the stratum's level rejects the row; a stratum without one rejects nothing."""
    return F.coalesce(severity() <= F.col("level"), F.lit(False))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, copy, STATS...) of every document: one narrow pass, written to the shared folder.

    Null text counts as empty; a null stratum is a stratum of its own ('').
    """
    s = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), rule_stats(F.col(text)).alias("s"), F.xxhash64(whole(F.col(text))).alias("copy"))
    return cut(s.select("doc_id", "stratum", "copy", "s.*"), "rules")


def consistent_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per labelled id; ids with contradicting labels, and nulls, are left out."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
    return seen.agg(F.min(label).alias(label), F.max(label).alias("_most")).where(F.col(label) == F.col("_most")).drop("_most")


def labelled_texts(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, quality, STATS...): one row for each labelled text of a stratum, however many rows repeat it.

    Repeats are no independent trials. Texts whose copies have contradicting labels are left out.
    """
    rows = stats.join(consistent_labels(labels), "doc_id").groupBy("stratum", "copy")
    each = rows.agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"), *[F.min(c).alias(c) for c in STATS])  # equal texts have equal statistics
    return each.where("quality = _most").drop("copy", "_most")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, stratum, the statistics, base_failed and kept of every document, repeated rows included.

    Null text is an empty text (fails the base rule); a null doc_id is carried but never labelled; empty
    tables give an empty result; other columns of docs are not read.
    """
    stats = measured(docs)
    levels = cut(fit_cutoffs(labelled_texts(stats, labels), risk, error), "levels")
    out = lookup_join(stats, levels, "stratum")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected()).drop("level", "copy")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs, whatever their names.

    Statistics are made once and written beside the rows; fitting reads only the statistics, and no text is shuffled.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    packed = docs.select(row, F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("stratum"), rule_stats(docs["text"]).alias("s"), F.xxhash64(whole(docs["text"])).alias("copy"))
    rows = cut(packed.select("_row", "stratum", "copy", "s.*"), "rules")
    stats = rows.select(F.col("_row.doc_id").alias("doc_id"), "stratum", "copy", *STATS)
    levels = cut(fit_cutoffs(labelled_texts(stats, labels), risk, error), "levels")
    marked = lookup_join(rows, levels, "stratum")
    return marked.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")) & ~rejected()).select("_row.*")
