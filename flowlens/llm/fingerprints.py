"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a document's 5-word shingles. Sketches of parts merge into
the sketch of the whole; two sketches estimate resemblance and containment, one estimates the number of
distinct shingles. Sketches of fewer than k hashes are complete, and their estimates exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.texts import by_text
from flowlens.plans.shared import cut

SHINGLE, K = 5, 256
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def _spread(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    words = data.split()
    return np.fromiter(map(digest, words), np.uint64, len(words))


def sketch_of(words: np.ndarray, k: int = K, n: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending, from hashes of the words in order.

    Fewer than n words make one shingle; no word makes none.
    """
    if not len(words):
        return np.empty(0, np.uint64)
    m = max(1, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for i in range(min(n, len(words))):
        h = _spread(h * _MIX[2] + words[i : i + m])
    h = np.unique(h)
    return h[:k]


def sketch(text: str | None, k: int = K, n: int = SHINGLE) -> np.ndarray:
    return sketch_of(word_hashes((text or "").encode("utf-8", "surrogatepass")), k, n)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union; parts' shingles that span a seam are in neither part."""
    return np.union1d(a, b)[:k]


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; two empty sets are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


def spelled(a: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, 8 bytes each, big-endian."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read_spelled(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def document_fingerprints(docs: DataFrame, k: int = K, n: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, n_shingles double) of every row: one narrow pass; null text counts as empty."""

    def of(texts: list) -> tuple[dict[str, pa.Array], None]:
        found = [sketch(t, k, n) for t in texts]
        return {"fingerprint": pa.array(list(map(spelled, found)), pa.string()), "n_shingles": pa.array([distinct_shingles(x, k) for x in found], pa.float64())}, None

    return by_text(docs, of, "fingerprint string, n_shingles double", doc_id, text)


def merge_fingerprints(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint) of the unions of fingerprints with the same key.

    Partitions merge their own first, so a hot key sends one sketch from each task, and then meets in salted
    groups. What both passes forget at a flush is made up for by the last merge, of all of a key's sketches.
    """
    kind = dict(parts.dtypes)[key]
    schema = f"`{key}` {kind}, fingerprint string"

    def written(keys: list, sketches: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(list(map(spelled, sketches)), pa.string())], [key, "fingerprint"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for x, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[x] = merge(held.get(x, np.empty(0, np.uint64)), read_spelled(f), k)
            if len(held) > 20_000:
                yield written(list(held), list(held.values()), b.schema.field(0).type)
                held = {}
        if held:
            yield written(list(held), list(held.values()), b.schema.field(0).type)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unions = [reduce(lambda a, f: merge(a, read_spelled(f), k), fs, np.empty(0, np.uint64)) for fs in b.column(1).to_pylist()]
            yield written(b.column(0).to_pylist(), unions, b.schema.field(0).type)

    once = parts.select(key, "fingerprint").mapInArrow(local, schema)
    salted = once.repartition(key, F.pmod(F.xxhash64("fingerprint"), F.lit(16))).mapInArrow(local, schema)
    return salted.groupBy(key).agg(F.collect_list("fingerprint").alias("fingerprint")).mapInArrow(listed, schema)


def _bucket(key: Column, bounds: str, n: int, kind: str) -> Column:
    """How many of the n ascending bounds (JSON, an array of structs (id, h)) are <= key, by binary search."""
    held = F.from_json(F.lit(bounds), f"array<struct<id:{kind},h:bigint>>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        up = (a["lo"] < a["hi"]) & ~_less(key, F.get(held, mid))
        return F.struct(F.when(up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(up | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step, lambda a: a["lo"])


def _less(a: Column, b: Column) -> Column:
    """Whether key a (id, h) comes before b; null ids come first."""
    tie = a["id"].eqNullSafe(b["id"])
    return F.when(tie, a["h"] < b["h"]).otherwise(a["id"].isNull() | F.coalesce(a["id"] < b["id"], F.lit(False)))


def in_sequence(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (b, late, doc_id, h, text), in order of doc_id (any type that sorts, null first; of one id, by the text's hash
    h) within a bucket b, and after a bucket's rows the row that follows it.

    Buckets are ranges of (doc_id, h), so one shuffle puts each row beside its next and texts that share an id are
    dealt out too; rows that are equal in both stay in one bucket, which is sorted on disk if it must. The first row
    of every bucket is sent to the bucket before as well (late = 1), the very first to the last. b is the partition's
    sort key: a bucket is in one partition.
    """
    n = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    slim = cut(rows.select("doc_id", "h"), "sequence")
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id"), "h"))  # no id before all ids
    ranges = slim.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("h")).groupBy(F.spark_partition_id().alias("p")).agg(least.alias("k"))
    bounds = [r["k"] for r in ranges.orderBy("k").select(F.to_json("k").alias("k")).collect()] if n > 1 else []  # a row for each bucket
    bounds = bounds[1:]
    listed = f"[{','.join(bounds)}]"
    key = lambda: F.struct(F.col("doc_id").alias("id"), F.col("h"))
    b = _bucket(key(), listed, len(bounds), kind)
    firsts = slim.select(b.alias("b"), F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id"), "h").groupBy("b").agg(F.min(F.struct("named", "id", "h")).alias("k"))
    firsts = firsts.orderBy("b").select("b", F.to_json("k").alias("k")).collect()  # a row for each bucket
    first, to = ["null"] * (len(bounds) + 1), [-1] * (len(bounds) + 1)
    for i, r in enumerate(firsts):
        first[r["b"]], to[r["b"]] = r["k"], firsts[i - 1]["b"]
    heads = F.from_json(F.lit(f"[{','.join(first)}]"), f"array<struct<id:{kind},h:bigint>>")
    before = F.split(F.lit(",".join(map(str, to))), ",").cast("array<int>")
    place = lambda at, late: F.struct(at.alias("b"), F.lit(late).alias("late"))
    own = F.array(place(F.col("b"), 0))
    both = F.array(place(F.col("b"), 0), place(F.get(before, F.col("b")), 1))
    head = F.get(heads, F.col("b"))
    sent = F.when(head["id"].eqNullSafe(F.col("doc_id")) & (head["h"] == F.col("h")), both).otherwise(own)
    placed = rows.withColumn("b", b).select("doc_id", "h", "text", F.explode(sent).alias("at")).select("doc_id", "h", "text", "at.*")
    return placed.repartition("b").sortWithinPartitions("b", "late", F.asc_nulls_first("doc_id"), "h", "text").select("b", "late", "doc_id", "h", "text")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much (or all) of the start of the following one."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def edit_likeness(docs: DataFrame, k: int = K, n: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, kept_part,
    both_shingles) of every row.

    The next document is that of the next larger doc_id (of rows with one id, by the text's hash), after the last the
    first. A lone document follows itself. Null texts are empty; null ids come first; an empty table gives none.
    n_shingles: estimate of the text's distinct shingles; kept_part: of the part of them that the edited text has;
    both_shingles: of the distinct shingles of both texts, from the merged sketch.
    """
    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_part double, both_shingles double"

    def row(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
        other = edited(text, following)
        mine = sketch(other, k, n)
        digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
        return len(text), digest, spelled(own), spelled(mine), resemblance(own, mine, k), resemblance(own, theirs, k), distinct_shingles(own, k), containment(own, mine, k), distinct_shingles(merge(own, mine, k), k)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: (b, late, id as an array of one, text, its sketch)
        for batch in batches:
            ids, out = [], []
            for i, (b, late, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                now = (b, late, batch.column(2).slice(i, 1), text, sketch(text, k, n))
                if held is not None and held[0] == b and not held[1]:
                    ids.append(held[2])
                    out.append(row(held[3], held[4], text, now[4]))
                held = now
            if out:
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 5], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *made], ["doc_id", *[c.split()[0] for c in schema.split(", ")]])

    kind = dict(docs.dtypes)["doc_id"]
    return in_sequence(docs, buckets).mapInArrow(of, f"doc_id {kind}, {schema}")
