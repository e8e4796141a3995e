"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes of a text sets chunk borders wherever it is least among its neighbours, so that equal
passages are cut alike wherever they stand. Chunks are compared by 128-bit digest; runs of neighbouring
chunks that occur elsewhere are repeats, and all but the first occurrence of a chunk can be cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.texts import by_text
from flowlens.plans.shared import cut, lookup_join

#: The gear hash sees WINDOW bytes; a border's hash is the least within REACH bytes on both sides; a chunk has REACH + 1 to MOST bytes.
WINDOW, REACH, MOST = 16, 24, 256
#: Bytes that a run of repeated chunks must have to be reported: about 20 words.
RUN = 100


def gear_table(seed: int = 7) -> np.ndarray:
    """A random 32-bit number for each byte value."""
    return np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i]), seed)[:4] for i in range(256)), "<u4").astype(np.uint32)


_GEAR = gear_table()


def _least_of(h: np.ndarray, n: int) -> np.ndarray:
    """Least of h[i : i + n] for each place i that has so many, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h, size = np.minimum(h[: len(h) - step], h[step:]), size + step
    return h


def borders(data: bytes) -> np.ndarray:
    """Ends of the chunks of data, ascending, the last at its length; none for no data.

    The hash at a byte is the sum of the last 16 gear values, each shifted left by its distance, mod 2**32; it is
    summed by doubling the window. A byte ends a chunk if its hash is the least within REACH bytes on both sides, so
    the rule looks at nearby bytes only, and an equal passage is cut alike but for its edges. Where text repeats with
    a short period such bytes are close; of those each is kept that is more than REACH behind the one kept before, so
    chunks are whole periods, alike wherever the count starts. A chunk longer than MOST is cut at multiples of MOST.
    """
    if not data:
        return np.empty(0, np.int64)
    h, step = _GEAR[np.frombuffer(data, np.uint8)], 1
    while step < WINDOW:
        back = np.zeros_like(h)
        back[step:] = h[:-step] << np.uint32(step)
        h, step = h + back, step * 2
    ends = np.empty(0, np.int64)
    if len(data) > 2 * REACH:
        least = _least_of(h, REACH)
        mid = h[REACH : len(h) - REACH]
        ends = np.flatnonzero((mid <= least[: len(mid)]) & (mid <= least[REACH + 1 : REACH + 1 + len(mid)])) + REACH + 1
        if (np.diff(ends) <= REACH).any():
            kept = [-REACH]
            for e in ends.tolist():
                if e - kept[-1] > REACH:
                    kept.append(e)
            ends = np.array(kept[1:])
    ends = np.append(ends, len(data))
    long = np.diff(ends, prepend=0)
    if (long > MOST).any():
        starts = ends - long
        ends = np.concatenate([np.append(np.arange(s + MOST, e, MOST), e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return ends


def chunk_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, i, start, size, hi, lo): every chunk of every row; start and size in bytes of the UTF-8 text.

    row tells repeated rows apart. A narrow pass; null and empty texts have no chunks.
    """

    def of(texts: list) -> tuple[dict[str, pa.Array], np.ndarray]:
        counts, starts, ends, digests = np.zeros(len(texts), np.int64), [], [], []
        for k, t in enumerate(texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            e = borders(data)
            s = np.concatenate([[0], e[:-1]]) if len(e) else e
            counts[k] = len(e)
            starts.append(s)
            ends.append(e)
            digests.extend(xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True))
        words = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        first, last = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int32) for x in (starts, ends))
        place = (np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        return {"i": pa.array(place), "start": pa.array(first), "size": pa.array(last - first), "hi": pa.array(words[:, 0]), "lo": pa.array(words[:, 1])}, counts

    return by_text(docs, of, "i int, start int, size int, hi long, lo long", doc_id, text, {"row": F.monotonically_increasing_id()})


def repeats(docs: DataFrame, run: int = RUN, across: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, start, end, n_chunks, first_doc_id, removable) of every repeated passage.

    A passage is a maximal run of neighbouring chunks of a row that all occur in another row too (across =
    False: or twice in this one) and all, or none, of which occur here first; runs of fewer than `run` bytes, all kinds counted, are chance and left out.
    first_doc_id: the row (smallest id, none last) whose first chunk of the run is kept; removable: all but first occurrences. Places
    are bytes of the UTF-8 text. Equal rows repeat each other; null and empty texts, and empty tables, give
    none; other columns are not read. Digests are counted with map-side combining, so a chunk in a third of
    all rows sends one row from each task; only repeated chunks are joined back.
    """
    chunks = cut(chunk_table(docs, doc_id, text), "chunks")
    where = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "i")  # rows without an id last
    more = (F.min("row").alias("low"), F.max("row").alias("high")) if across else (F.lit(1).alias("low"), F.count("*").alias("high"))
    seen = chunks.groupBy("hi", "lo").agg(*more, F.min(where).alias("first")).where("low < high").select("hi", "lo", "first")
    seen = cut(seen, "seen")  # written: the join then starts at shuffles, which AQE splits where a chunk is hot, or broadcasts if few repeat
    own = cut(lookup_join(chunks, seen, ["hi", "lo"], "inner").select("doc_id", "row", "i", "start", "size", F.col("first.doc_id").alias("first_doc_id"), ((F.col("first.row") == F.col("row")) & (F.col("first.i") == F.col("i"))).alias("is_first")), "repeats")
    along = Window.partitionBy("row").orderBy("i")  # the repeated chunks of one text
    island = own.withColumn("island", F.col("i") - F.row_number().over(along))
    total = F.sum("size").over(Window.partitionBy("row", "island"))
    long = island.withColumn("total", total).where(F.col("total") >= run)
    turn = (F.col("is_first") != F.lag("is_first", 1).over(Window.partitionBy("row", "island").orderBy("i"))).cast("int")
    parts = long.withColumn("turn", F.coalesce(turn, F.lit(0))).withColumn("part", F.sum("turn").over(Window.partitionBy("row", "island").orderBy("i")))
    spans = parts.groupBy("row", "island", "part").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.col("size")).cast("long").alias("end"), F.count("*").alias("n_chunks"),
        F.min_by("first_doc_id", "i").alias("first_doc_id"), (~F.min("is_first")).alias("removable"),
    )
    return spans.select("doc_id", "row", "start", "end", "n_chunks", "first_doc_id", "removable")


def without_repeats(text: Column, spans: Column) -> Column:
    """The text without the byte spans, array<struct<start, end>> sorted by start, none overlapping; broken characters at a border go."""
    whole = F.encode(text, "UTF-8")
    size = F.octet_length(text).cast("long")

    def piece(_: Column, i: Column) -> Column:
        begin = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        end = F.coalesce(F.get(spans, i)["start"], size)
        return F.try_validate_utf8(F.substring(whole, begin.cast("int") + 1, (end - begin).cast("int")).cast("string"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), "")
