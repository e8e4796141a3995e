"""Phrase collocations by pivot partitioning, after MG-FSM (Miliaraki et al., 2013).

Words are ordered by frequency. Each occurrence of a word is rewritten to the fragment of its piece in which it is the
rarest word, and the fragment is routed to that word, its pivot; there it is mined for the phrases that the pivot owns. So each
phrase is counted in one place, most fragments of frequent words are a word long and are not sent, and equal fragments are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.texts import whole
from flowlens.plans.shared import cut, lookup_join, sums_before

#: What splits a text into pieces, and the most words a phrase has; least count of a phrase; phrases reported for each language.
BREAKS = r"[.,;:!?\x0A-\x0D]"
MOST_WORDS, LEAST, TOP = 3, 10, 2000
#: A phrase is dropped if a longer one holds it and has this share, in percent, of its count.
INSIDE = 50
UNITS = 1_000_000
#: Buckets of the order of words: each holds the largest frequency of its words, so the table has a bound at any vocabulary.
BUCKETS = 1 << 20
#: Bytes of text that are cut up at once; a longer text is taken whole. A pivot with more than 1 / SHARE of all words is split.
SLICE, SHARE = 1 << 20, 1024


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE bytes of text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, side="right")))
        yield batch.take(pa.array(np.arange(begin, end)))  # a copy: kernels do not all heed the offset of a slice
        begin = end
        pa.default_memory_pool().release_unused()  # else what each step of a slice took stays with the worker


def cut_up(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(entry of each place or -1 where pieces end, language of each entry, word of each entry, hash of each entry).

    batch: (lang, text). An entry is a word of a language; every text begins with a -1.
    """
    texts = pc.ascii_lower(batch.column(1).cast(pa.large_string(), safe=False)).cast(pa.large_binary())
    texts = pc.replace_substring_regex(texts, pattern=BREAKS, replacement=b" \n ")
    texts = pc.replace_substring(texts, pattern=b"\t", replacement=b" ")
    texts = pc.binary_join_element_wise(pa.scalar(b"\n", pa.large_binary()), texts, pa.scalar(b" ", pa.large_binary()))
    lists = pc.split_pattern(texts, b" ")
    langs = batch.column(0).dictionary_encode()
    lang_of = np.repeat(np.asarray(langs.indices), np.diff(np.asarray(lists.offsets)))
    coded = lists.flatten().dictionary_encode()
    word, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    empty = names.index(pa.scalar(b"", names.type)).as_py()
    end = names.index(pa.scalar(b"\n", names.type)).as_py()
    real = word != empty
    word, lang_of = word[real], lang_of[real]
    key = lang_of * len(names) + word
    key[word == end] = -1
    used, entry = np.unique(key, return_inverse=True)
    if len(used) and used[0] == -1:
        used, entry = used[1:], entry - 1
    lang_entry, word_entry = langs.dictionary.take(pa.array(used // len(names))), names.take(pa.array(used % len(names)))
    seeds = [xxhash.xxh64_intdigest(x.encode("utf-8")) for x in langs.dictionary.to_pylist()]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(word_entry.to_pylist(), (used // len(names)).tolist(), strict=True)), np.uint64, len(used))
    return entry, lang_entry, word_entry.cast(pa.large_string(), safe=False), hashes


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, bucket int, f): occurrences of each word of each language. docs: (lang string, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                entry, lang, word, hashes = cut_up(part)
                n = np.bincount(entry[entry >= 0], minlength=len(word))
                yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), word.cast(pa.string()), pa.array((hashes % np.uint64(BUCKETS)).astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "word", "bucket", "n"])

    counted = docs.mapInArrow(run, "lang string, word string, bucket int, n long")
    return counted.groupBy("lang", "word", "bucket").agg(F.sum("n").alias("f"))


def order_table(words: DataFrame, least: int = LEAST) -> np.ndarray:
    """For each bucket the largest frequency of its words, 0 where none is frequent: BUCKETS numbers, whatever the vocabulary."""
    rows = words.where(F.col("f") >= least).groupBy("bucket").agg(F.max("f").alias("f")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("f").to_numpy()
    return out


def _rarity(f: np.ndarray, hashes: np.ndarray, words: pa.Array) -> np.ndarray:
    """Places of entries in the order of words: by descending frequency of their bucket, then hash, then the word itself."""
    by = [hashes, -f]
    if len(np.unique(hashes)) < len(hashes):
        by.insert(0, np.argsort(np.argsort(np.array(words.cast(pa.large_binary()).to_pylist(), object), kind="stable")))
    out = np.empty(len(f), np.int64)
    out[np.lexsort(by)] = np.arange(len(f))
    return out


def fragments_of(entry: np.ndarray, rank: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragments, counts): the distinct fragments as five entries (two before the pivot, the pivot, two after; -1: none).

    A word before the pivot must be less rare, one after at most as rare, so an occurrence of a phrase belongs to the first
    occurrence of its rarest word. Words that are not frequent, and ends of pieces, end a fragment.
    """
    far = MOST_WORDS - 1
    frequent, rank = np.append(frequent, False), np.append(rank, np.iinfo(np.int64).max)  # at -1: nothing is as rare as a gap
    wide = np.concatenate([np.full(far, -1), np.where(frequent[entry], entry, -1), np.full(far, -1)])
    place = rank[wide]
    mid = slice(far, len(wide) - far)
    own = place[mid]
    parts = [wide[mid]]
    for side, within in ((-1, own), (1, own + 1)):
        ok = wide[mid] >= 0
        for k in range(1, far + 1):
            at = slice(far + side * k, len(wide) - far + side * k)
            ok = ok & (place[at] < within)
            part = np.where(ok, wide[at], -1)
            parts = [part, *parts] if side < 0 else [*parts, part]
    rows = np.column_stack(parts).astype(np.int32)
    rows = rows[(rows[:, far - 1] >= 0) | (rows[:, far + 1] >= 0)]
    if not len(rows):
        return rows, np.empty(0, np.int64)
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[begin], np.diff(np.append(begin, len(rows)))


def fragments(docs: DataFrame, table: np.ndarray, most: int) -> DataFrame:
    """(lang, pivot, salt, split, b2, b1, a1, a2, c): fragments with how often they occur in a slice of texts.

    salt: 0 but for pivots that occur more than `most` times, whose fragments are dealt by their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                entry, lang, word, hashes = cut_up(part)
                f = table[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
                rows, counts = fragments_of(entry, _rarity(f, hashes, word), f > 0)
                salts = -(-f[rows[:, 2]] // most) if len(rows) else np.empty(0, np.int64)
                mixed = np.zeros(len(rows), np.uint64)
                for k in (0, 1, 3, 4):
                    mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ np.where(rows[:, k] >= 0, hashes[rows[:, k]], np.uint64(k))
                salt = ((mixed >> np.uint64(20)) % np.maximum(salts, 1).astype(np.uint64)).astype(np.int32)
                word = word.cast(pa.string())
                at = lambda k: word.take(pa.array(rows[:, k], mask=rows[:, k] < 0))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([lang.cast(pa.string()).take(pa.array(rows[:, 2])), at(2), pa.array(salt), pa.array(salts > 1), at(0), at(1), at(3), at(4), pa.array(counts.astype(np.int64))], ["lang", "pivot", "salt", "split", "b2", "b1", "a1", "a2", "c"])

    return docs.mapInArrow(run, "lang string, pivot string, salt int, split boolean, b2 string, b1 string, a1 string, a2 string, c long")


def mine(sent: DataFrame, partitions: int | None = None, least: int = LEAST) -> DataFrame:
    """(lang, x, y, z, a): phrases x y (z null) and x y z with at least `least` occurrences, from fragments.

    Fragments are dealt by language, pivot and salt; a pivot's phrases are counted where it is, without another shuffle, and
    only the counts of split pivots are added up across their parts.
    """
    by = ["lang", "pivot", "salt"]
    dealt = sent.repartition(partitions, *by) if partitions else sent.repartition(*by)
    none = F.lit(None).cast("string")
    phrase = lambda x, y, z, ok: F.when(ok, F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    b2, b1, p, a1, a2 = map(F.col, ("b2", "b1", "pivot", "a1", "a2"))
    owned = F.array(
        phrase(b1, p, none, b1.isNotNull()), phrase(p, a1, none, a1.isNotNull()), phrase(b2, b1, p, b2.isNotNull()),
        phrase(b1, p, a1, b1.isNotNull() & a1.isNotNull()), phrase(p, a1, a2, a2.isNotNull()),
    )
    rows = dealt.select(*by, "split", "c", F.explode(owned).alias("o")).where("o is not null")
    local = rows.groupBy(*by, "o.x", "o.y", "o.z").agg(F.sum("c").alias("a"), F.max("split").alias("split"))
    return local.where(F.col("split") | (F.col("a") >= least)).groupBy("lang", "x", "y", "z").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """Frequent phrases (lang, x, y, z, a) with l and r of their lowest-scoring cut and its score.

    words: (lang, word, f), frequent ones. Parts of a frequent phrase are frequent, so they are among these rows.
    """
    f = lambda c: words.select("lang", F.col("word").alias(c), F.col("f").alias(f"f{c}"))
    pairs = found.where("z is null").select("lang", "x", "y", "a")
    triples = found.where("z is not null")
    score = lambda left, right: F.expr(f"cast({UNITS} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")
    short = lookup_join(lookup_join(pairs, f("x"), ["lang", "x"], "inner"), f("y"), ["lang", "y"], "inner")
    short = short.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), score("fx", "fy").alias("score"))
    ends = lookup_join(lookup_join(triples, f("x"), ["lang", "x"], "inner"), f("z"), ["lang", "z"], "inner")
    first = pairs.select("lang", "x", "y", F.col("a").alias("fxy"))
    last = pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz"))
    long = lookup_join(lookup_join(ends, first, ["lang", "x", "y"], "inner"), last, ["lang", "y", "z"], "inner")
    cuts = F.array_min(F.array(F.struct(score("fx", "fyz").alias("score"), F.lit(1).alias("k"), F.col("fx").alias("l"), F.col("fyz").alias("r")), F.struct(score("fxy", "fz").alias("score"), F.lit(2).alias("k"), F.col("fxy").alias("l"), F.col("fz").alias("r"))))
    long = long.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return short.unionByName(long)


def alone(found: DataFrame) -> DataFrame:
    """(lang, phrase) of the pairs that a longer phrase with at least INSIDE percent of their count holds."""
    inner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    held = found.where("z is not null").select("lang", F.explode(F.array(inner("x", "y"), inner("y", "z"))).alias("p"), "a").groupBy("lang", "p.x", "p.y").agg(F.max("a").alias("longer"))
    pairs = found.where("z is null").drop("z")
    return pairs.join(held, ["lang", "x", "y"]).where(100 * F.col("longer") >= INSIDE * F.col("a")).select("lang", F.concat_ws(" ", "x", "y").alias("phrase"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score, count, then phrase in byte order.

    A phrase has two or three words of one piece and at least `least` occurrences a. n: words of the language; l and r: counts of the
    two parts of its lowest-scoring cut, the smaller k on ties. Pairs that a longer phrase mostly holds are left out.
    Texts are read whole; null and empty ones have no words, a null language is `und`. Repeated rows count each
    time. An empty table, or one without frequent phrases, gives no rows; other columns are not read. Counts below 10**15 and
    products of three of them are exact (decimals).
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole(F.col(text)).alias("text"))
    counted = cut(word_counts(rows), "words")
    totals = cut(counted.groupBy("lang").agg(F.sum("f").alias("n")), "langwords")
    words = cut(counted.where(F.col("f") >= least).select("lang", "word", "f", "bucket"), "frequent")
    most = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // SHARE)
    found = cut(mine(fragments(rows, order_table(words, least), most), least=least), "phrases")
    kept = cut(scored(found, words.drop("bucket")).join(alone(found), ["lang", "phrase"], "left_anti"), "scored")
    listed = cut(kept.groupBy("lang").agg(F.count("*").alias("own")), "listed")
    earlier = cut(sums_before(listed, ["lang"], earlier=F.col("own")).select("lang", "earlier"), "earlier")
    placed = sums_before(kept, ["lang", F.desc("score"), F.desc("a"), "phrase"], before=F.lit(1))  # a language may hold most phrases: no window over it
    ranked = lookup_join(placed, earlier, "lang", "inner").withColumn("rank", (F.col("before") - F.col("earlier") + 1).cast("long")).where(F.col("rank") <= top)
    return lookup_join(ranked, totals, "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
