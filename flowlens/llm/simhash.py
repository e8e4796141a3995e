"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared in blocks of 64: bit plane p of a block is one 64-bit word that holds bit p of its
64 fingerprints. A query XORs its bit p with the plane and adds the differing lanes into carry-save counters,
so one pass over the planes counts 64 distances at once; a block is abandoned when all its lanes exceed the
radius. Blocks come from buckets of fingerprints that agree in some bits (pigeonhole), so no pair within the
radius is missed and no bucket holds more than it must; or, for wide fingerprints and a stated similarity of shingle
sets, from buckets of sampled bits. Equal fingerprints are one fingerprint throughout.
"""

from __future__ import annotations

import json
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.texts import by_text
from flowlens.operators.components import component_roots
from flowlens.plans.shared import cut, lookup_join

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: How sure a pair just at a stated similarity is within the radius, and shares a key.
RECALL = 0.97
#: Fingerprints of a bucket that meet in one piece of work; larger buckets are split into pairs of such chunks.
CHUNK = 4096
#: Expected fingerprints in a bucket; sets how many bits a key has.
BUCKET = 64


def shingle_hashes(text: str | None, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the n-word shingles, repeats included; A-Z lower-cased; no word: none; fewer than n: one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(n, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[s:e], seed) for s, e in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprint of 64 * words bits: those set in over half the hashes; word w > 0 uses hashes mixed anew from h."""
    found = np.zeros(words, np.uint64)
    for w in range(words if len(h) else 0):
        mixed = h
        if w:
            mixed = (h + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(32)
        ones = np.zeros(BITS, np.int64)
        for part in range(0, len(h), 1 << 16):
            ones += np.unpackbits(mixed[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found[w] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return found


def simhash(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the n-word shingles; no word: 0."""
    return int(majority(shingle_hashes(text, n, seed))[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, words: int = 1) -> DataFrame:
    """(doc_id, w0 long, w1 ...) of every row: one narrow pass. Null and wordless texts have fingerprint 0."""

    def of(texts: list) -> tuple[dict[str, pa.Array], None]:
        fp = np.array([majority(shingle_hashes(t, n), words) for t in texts], np.uint64).reshape(-1, words).view(np.int64)
        return {f"w{w}": pa.array(fp[:, w]) for w in range(words)}, None

    return by_text(docs, of, ", ".join(f"w{w} long" for w in range(words)), doc_id, text)


def key_scheme(n: int, radius: int = RADIUS) -> list[list[int]]:
    """Masks (one word each) such that any two words within the radius agree on one of them, for n fingerprints.

    The bits are cut into radius + c parts; a mask keeps c of them, the fewest for which buckets of random
    fingerprints stay near BUCKET. More fingerprints mean longer keys and more masks, not larger buckets.
    """
    for c in range(1, 5):
        parts = np.array_split(np.arange(BITS), radius + c)
        kept = sum(len(p) for p in parts[:c])
        if c == 4 or n >> kept <= BUCKET:
            break
    return [[sum(1 << int(b) for p in chosen for b in p)] for chosen in combinations(parts, c)]


def sampled_scheme(n: int, words: int, similarity: float, recall: float = RECALL) -> list[list[int]]:
    """Masks of sampled bits for wide fingerprints, whose radius no pigeonhole covers.

    Each keeps as many bits as keep buckets of random fingerprints near BUCKET, drawn with a fixed seed; there are so
    many masks that two texts of the stated shingle similarity agree on one with the stated probability: about
    n ** 0.24 times a constant.
    """
    bits = words * BITS
    kept = max(4, min(48, (max(n // BUCKET, 1) - 1).bit_length()))
    agree = (1 - angle(similarity)) ** kept
    rng = np.random.default_rng(20)
    masks = []
    for _ in range(int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))):
        chosen = rng.choice(bits, kept, replace=False).tolist()
        masks.append([sum(1 << (b % BITS) for b in chosen if b // BITS == w) for w in range(words)])
    return masks


def angle(similarity: float) -> float:
    """Expected share of differing bits of two texts whose sets of shingles have this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_radius(similarity: float, words: int, recall: float = RECALL) -> int:
    """Differing bits that a pair of exactly this similarity stays within with the stated probability (normal tail)."""
    p, bits = angle(similarity), words * BITS
    return int(bits * p + NormalDist().inv_cdf(recall) * np.sqrt(bits * p * (1 - p)))


def planes(fps: np.ndarray) -> np.ndarray:
    """(64 m, blocks) words: bit i of word [p, b] is bit p of fingerprint 64 * b + i; fps as uint64 (n, m), padded with its first."""
    bits = fps.shape[1] * BITS
    pad = -len(fps) % 64
    full = np.concatenate([fps, np.repeat(fps[:1], pad, axis=0)]) if pad else fps
    rows = np.unpackbits(np.ascontiguousarray(full).view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(rows.reshape(-1, 64, bits).transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def near_lanes(queries: np.ndarray, blocks: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(entries, lanes): of each entry (query words, block number) the lanes within the radius; entries without any are left out.

    Carry-save counters just wide enough for radius + 1, which marks a lane in `over` for good; every eight
    planes the entries are dropped whose lanes are all over.
    """
    limit = radius + 1
    live = np.arange(len(queries))
    c = [np.zeros(len(queries), np.uint64) for _ in range(limit.bit_length())]
    over = np.zeros(len(queries), np.uint64)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(queries.shape[1] * BITS):
        carry = sliced[p, blocks] ^ (-((queries[:, p // BITS] >> np.uint64(p % BITS)) & np.uint64(1)).astype(np.int64)).view(np.uint64)
        for i in range(len(c)):
            c[i], carry = c[i] ^ carry, c[i] & carry
        reached = every
        for i in range(len(c)):
            reached = reached & (c[i] if limit >> i & 1 else ~c[i])
        over |= reached
        if p % 8 == 7:
            keep = over != every
            if not keep.all():
                live, queries, blocks, over, c = live[keep], queries[keep], blocks[keep], over[keep], [x[keep] for x in c]
    return live, ~over


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Roots of 0..n-1 after joining the pairs (a, b), by hooking to the smaller root and halving paths."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def links_within(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int = RADIUS, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (two arrays of nodes) of all pairs within the radius that share a key; fps: uint64 (n, words).

    Rows are sorted by key. side: 0 if the row meets all others of its key; a row with 1 meets only those
    with 2. Memory is bounded by `most` entries of a query and a block at once.
    """
    order = np.lexsort((nodes, side, keys))
    keys, nodes, fps, side = keys[order], nodes[order], fps[order], side[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    ends = np.append(begin[1:], len(keys))
    root = np.arange(len(fps))
    todo: list[tuple[int, int, int, int]] = []  # queries from, to; lanes from, to
    for s, e in zip(begin.tolist(), ends.tolist(), strict=True):
        if e - s < 2:
            continue
        if side[s] == 0:
            todo.append((s, e, s, e))
        else:
            m = s + int(np.searchsorted(side[s:e], 2))
            if s < m < e:
                todo.append((s, m, m, e))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> None:
        nonlocal root
        if not waiting:
            return
        slices = [planes(fps[lo:hi]) for lo, hi in lanes]
        sliced = np.concatenate(slices, axis=1)
        q, blk = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
        live, hit = near_lanes(fps[q], blk, sliced, radius)
        at = np.concatenate([lo + 64 * np.arange(-(-(hi - lo) // 64)) for lo, hi in lanes])
        stop = np.concatenate([np.full(-(-(hi - lo) // 64), hi) for lo, hi in lanes])
        for part in range(0, len(live), 1 << 14):
            some = slice(part, part + (1 << 14))
            lit = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, lane = np.nonzero(lit)
            k = live[some][e]
            other = at[blk[k]] + lane
            real = other < stop[blk[k]]
            root = _forest(len(fps), q[k][real], other[real], root)
        waiting.clear()
        lanes.clear()

    lanes: list[tuple[int, int]] = []
    held, blocks = 0, 0
    for qs, qe, ls, le in todo:
        n = -(-(le - ls) // 64)
        for s in range(qs, qe, max(1, most // n)):
            rows = np.arange(s, min(qe, s + max(1, most // n)))
            if held and held + len(rows) * n > most:
                flush()
                held, blocks = 0, 0
            waiting.append((np.repeat(rows, n), blocks + np.tile(np.arange(n), len(rows))))
            lanes.append((ls, le))
            blocks += n
            held += len(rows) * n
    flush()
    child = np.flatnonzero(root != np.arange(len(fps)))
    return nodes[child], nodes[root[child]]


def near_links(distinct: DataFrame, n: int, masks: list[list[int]], radius: int = RADIUS) -> DataFrame:
    """(src, dst): spanning links of the graph that joins fingerprints within the radius that agree on some mask.

    distinct: (node long, w0 long, ...), n rows, each fingerprint once. Each mask's buckets are spread over tasks by a
    hash of the key; a bucket of more than CHUNK fingerprints is cut into chunks by a hash of the fingerprint, and
    each pair of its chunks is work of its own. A bucket yields fewer links than it has members, never all its pairs.
    """
    ws = [c for c in distinct.columns if c != "node"]
    signed = [[m - (1 << 64) if m >> 63 else m for m in mask] for mask in masks]
    keyed = distinct.select("*", F.posexplode(F.from_json(F.lit(json.dumps(signed)), "array<array<bigint>>")).alias("t", "mask"))
    keyed = keyed.select("node", *ws, F.xxhash64("t", *[F.col(w).bitwiseAND(F.get("mask", F.lit(i))) for i, w in enumerate(ws)]).alias("key"))
    sizes = keyed.groupBy("key").count()
    large = cut(sizes.where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "simhot")
    keyed = lookup_join(keyed, large, "key").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64(*ws), F.col("chunks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = keyed.select("node", *ws, "key", own.alias("own"), other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    work = pairs.select("node", *ws, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), side.alias("side"))
    groups = max(8, n * len(masks) // 100_000)

    def of(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("key", "node", "side", *ws)}
        fps = np.column_stack([columns[w] for w in ws]).view(np.uint64)
        a, b = links_within(columns["key"], columns["node"], fps, columns["side"], radius)
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    return work.withColumn("g", F.pmod("key", F.lit(groups))).groupBy("g").applyInArrow(of, "src long, dst long").distinct()


def near_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None, words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of every row: the smallest doc_id that links of at most `radius` differing bits reach.

    similarity: link by 64 * words bits instead, within the radius that holds pairs of this Jaccard similarity of
    shingles, and by sampled keys; both are set for RECALL, so a pair just at the bound is linked with probability
    RECALL squared, a nearer one with more. fp is the first word. Rows with a null id are labelled like others and
    only name a component that has no other id (null). Equal rows get equal results; an empty table gives none; other
    columns of docs are not read.
    """
    of = cut(fingerprints(docs, doc_id, text, shingle, words), "simhash")
    ws = [f"w{w}" for w in range(words)]
    node = F.col("w0") if words == 1 else F.monotonically_increasing_id()
    reps = cut(of.groupBy(*ws).agg(F.min("doc_id").alias("least")).select("*", node.alias("node")), "simreps")
    n = reps.count()
    masks = key_scheme(n, radius) if similarity is None else sampled_scheme(n, words, similarity)
    radius = radius if similarity is None else wide_radius(similarity, words)
    roots = cut(component_roots(near_links(reps.select("node", *ws), n, masks, radius)), "simroots") if n > 1 else None
    if roots is None:
        return of.join(reps, ws).select("doc_id", F.col("w0").alias("fp"), F.col("least").alias("component_id"))
    named = cut(reps.join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select(*ws, "least", F.coalesce("root", "node").alias("root")), "simnamed")
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "simleast")  # written: the join then starts at
    labels = cut(named.join(least, "root").select(*ws, "component_id"), "simlabels")  # shuffles, which AQE splits where a root is hot
    return of.join(labels, ws).select("doc_id", F.col("w0").alias("fp"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None, words: int = 1) -> DataFrame:
    """docs with one row of each component: that of the smallest id, of rows that share this id one text, of rows that share
    both the one whose other columns hash least, so reruns agree.

    A row is told by its id and a hash of its text, so texts that share an id are judged apart. Rows with a null id are
    kept. Empty and null texts are copies of each other; an empty table stays empty. The columns are those of docs, whatever
    their names. Texts move once at most: what is decided, on slim rows, is joined to them, and only rows that share id and text
    are told apart after that. Other parameters: see near_components.
    """
    key = F.struct(docs["doc_id"].isNull().alias("unnamed"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("h"))  # ids before none
    rest = F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_none"))))
    found = near_components(docs.select(key.alias("doc_id"), docs["text"].alias("text")), radius, shingle, similarity, words)
    lost = found.where("not doc_id.unnamed and doc_id <> component_id").select(F.col("doc_id").alias("_key"), F.lit(True).alias("_gone"), F.lit(None).cast("long").alias("_least"))
    shared = docs.select(key.alias("_key"), rest.alias("_rest")).where("not _key.unnamed").groupBy("_key").agg(F.count("*").alias("n"), F.min("_rest").alias("_least")).where("n > 1")
    verdict = lost.unionByName(shared.select("_key", F.lit(False).alias("_gone"), "_least")).groupBy("_key").agg(F.max("_gone").alias("_gone"), F.max("_least").alias("_least"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), key.alias("_id"), rest.alias("_rest"))
    marked = lookup_join(packed, cut(verdict, "simverdict"), F.col("_id") == F.col("_key"), "left").where("not coalesce(_gone, false)")
    alone = marked.where("_least is null")
    first = marked.where("_least is not null and _rest = _least").dropDuplicates(["_id"])  # equal rows by now
    return alone.unionByName(first).select("_row.*")
