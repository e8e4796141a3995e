"""Classifiers, fingerprints, packing, SimHash and chunks against plain Python, and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import chunks, fingerprints, language, packing, quality_qda, simhash
from flowlens.llm.queries import op1_quality, op4_fingerprints, op5_packing, op6_simhash, op7_chunks, op9_language

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(doc_id, n, k):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == k


def test_quality_learns_and_scores_everything(spark, odd, labels, tables):
    rows = op1_quality(spark, tables).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    good = [(i, prose(i, 80), "en", "a", 0) for i in range(60)]
    bad = [(100 + i, "BUY NOW!! " * (10 + i) + "$$$ ### " * 9, "en", "a", 0) for i in range(60)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    marks = spark.createDataFrame([(d[0], int(d[0] < 100)) for d in good + bad], "doc_id long, quality int")
    made = quality_qda.score_quality(docs, marks).where("held_out").collect()
    assert len(made) > 10 and all(r["predicted"] == int(r["doc_id"] < 100) for r in made)


def test_quality_without_labels_is_even(odd, labels):
    assert {r["score"] for r in quality_qda.score_quality(odd, labels.where("false")).collect()} == {0.5}


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    cov = [np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([[1.0, -0.2], [-0.2, 0.5]])]
    mean = [np.zeros(2), np.array([1.0, 2.0])]
    parts = tuple((np.log(p), m, np.linalg.inv(np.linalg.cholesky(c)), np.log(np.linalg.det(c))) for p, m, c in zip((0.3, 0.7), mean, cov, strict=True))
    x = rng.normal(size=(5, 2))
    logs = [np.log(p) - 0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.log(np.linalg.det(c))) for p, m, c in zip((0.3, 0.7), mean, cov, strict=True)]
    assert quality_qda.Discriminant(parts, 1.0).scores(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_language(spark, tables, odd):
    rows = op9_language(spark, tables).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 5, 0) for r in rows)
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or ""))
    english, german = "the and of to in that with for house".split(), "der und die das nicht ist mit straße schön".split()
    make = lambda words, seed: " ".join(random.Random(seed).choices(words, k=60))
    docs = spark.createDataFrame([(i, make(english if i % 2 else german, i), "en" if i % 2 else "de", "a", 0) for i in range(60)], SCHEMA)
    made = language.identify(docs).where("held_out").collect()
    assert made and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in made)


def test_grams_by_hand():
    codes, counts = language.grams("Ab, ab!")
    want = collections.Counter()
    text = " ab ab "
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            g = text[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " ") and not (n == 1 and g == " "):
                want[g] += 1
    decode = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s & 0x1FFFFF)
    assert {decode(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == dict(want)


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_sketch(text):
    """The 256 smallest hashes of 5-word shingles, one number at a time."""
    w = [xxhash.xxh3_64_intdigest(x) for x in text.encode().split()]
    full = (1 << 64) - 1
    found = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 0
        for x in w[i : i + 5]:
            h = (h * 0x9E3779B97F4A7C15 + x) & full
            h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & full
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) & full
            h ^= h >> 31
        found.add(h)
    return sorted(found)[:256]


def plain_likeness(a, b):
    least = sorted(set(a) | set(b))[:256]
    return sum(x in set(a) and x in set(b) for x in least) / len(least) if least else 1.0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, odd, tables):
    rows = op4_fingerprints(spark, tables).collect()
    tie = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64))
    docs = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in odd.collect()), key=lambda r: (r[0], tie(r[1])))
    want = collections.Counter()
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        e = fingerprints.edited(t, after)
        a, b, c = (plain_sketch(x) for x in (t, e, after))
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_likeness(a, b), plain_likeness(a, c))] += 1
    got = [(r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows]
    assert collections.Counter(got) == want
    assert {r["fingerprint"] for r in rows} == {fingerprints.spelled(np.array(plain_sketch(t), np.uint64)) for _, t in docs}
    text = dict(docs)
    for r in rows:
        t = text[r["doc_id"] if r["doc_id"] is not None else -(1 << 63)]
        if len(shingles(t)) < 200 and r["doc_id"] is not None:
            assert fingerprints.distinct_shingles(fingerprints.read_spelled(r["fingerprint"])) == len(shingles(t))


def test_sketch_estimates():
    a, b = prose(1, 4000), prose(1, 3000) + " " + prose(2, 1000)
    x, y = fingerprints.sketch(a), fingerprints.sketch(b)
    assert abs(fingerprints.resemblance(x, y) - jaccard(shingles(a), shingles(b))) < 0.12
    assert abs(fingerprints.containment(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.15
    assert abs(fingerprints.distinct_shingles(x) / len(shingles(a)) - 1) < 0.2
    assert fingerprints.resemblance(fingerprints.sketch(""), fingerprints.sketch(None)) == 1.0


def test_merge_is_the_sketch_of_the_union(spark):
    parts = spark.createDataFrame([("k", prose(i, 300), i) for i in range(6)] + [("l", prose(9, 40), 9)], "key string, text string, doc_id long")
    made = parts.join(fingerprints.document_fingerprints(parts), "doc_id")
    got = {r["key"]: r["fingerprint"] for r in fingerprints.merge_fingerprints(made, "key").collect()}
    union = np.empty(0, np.uint64)
    for i in range(6):
        union = np.union1d(union, fingerprints.sketch(prose(i, 300), 10**9))
    assert got["k"] == fingerprints.spelled(union[: fingerprints.K]) and got["l"] == fingerprints.spelled(fingerprints.sketch(prose(9, 40)))


def check_packing(rows, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for (d, t), n in docs.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(d, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(fill)


def test_packing(spark, odd, tables):
    more = [(200, "a  b \n\n c", None, None, 0), (201, " lead and trail ", None, None, 0), (202, "an <|endoftext|> inside", None, None, 0), (203, "x y\tz it's we'll 12,5", None, None, 0)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))
    import public_tokenizers

    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    n = check_packing(rows, collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect()))
    assert n - -(-sum(r["length"] for r in rows) // 1024) <= 1
    assert op5_packing(spark, tables).count() > odd.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_local_search_never_worsens(lengths):
    lengths = np.array(lengths)
    first = packing.best_fit(lengths, 64)
    better = packing.improve(lengths, first, 64)
    for bins in (first, better):
        assert np.bincount(bins, weights=lengths).max() <= 64
    assert len(set(better.tolist())) <= len(set(first.tolist()))
    square = lambda b: (np.bincount(b, weights=lengths) ** 2).sum()
    assert square(better) >= square(first)


def test_swaps_empty_a_bin():
    """Best fit needs three bins of 10 for 6, 4, 4, 3, 3 in a bad order; moves and exchanges find two."""
    lengths, bins = np.array([6, 3, 4, 4, 3]), np.array([0, 0, 1, 1, 2])
    assert len(set(packing.improve(lengths, bins, 10).tolist())) == 2


def plain_simhash(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """Smallest id reachable, from (id, fingerprint) rows."""
    groups = [({d for d in [i] if d is not None}, {f}) for i, f in pairs]
    merged = []
    for ids, fps in groups:
        near = [g for g in merged if any(bin(a ^ b).count("1") <= 4 for a in g[1] for b in fps)]
        for g in near:
            merged.remove(g)
            ids, fps = ids | g[0], fps | g[1]
        merged.append((ids, fps))
    return {f: min(ids, default=None) for ids, fps in merged for f in fps}


def test_simhash(spark, odd, tables):
    rows = op6_simhash(spark, tables).collect()
    docs = [(r["doc_id"], plain_simhash(r["text"] or "")) for r in odd.collect()]
    of = plain_components(docs)
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == collections.Counter((d, f"{f:016x}", of[f]) for d, f in docs)
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns
    want = sorted({c for c in of.values() if c is not None})
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == want


@pytest.mark.parametrize("n", [1_000, 3_000_000, 10**9])
def test_links_lose_no_pair(n):
    """Every mask scheme, split buckets included, joins what brute force joins."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:60] ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64) for _ in range(k)]) for k in (1, 2, 4, 5)]]))
    masks = simhash.key_scheme(n)
    keys = np.concatenate([(fps & np.uint64(m)) * np.uint64(2 * i + 1) + np.uint64(i) for i, (m,) in enumerate(masks)]).view(np.int64)
    every = np.tile(fps, len(masks))
    a, b = simhash.links_within(keys, every, every[:, None], np.zeros(len(keys), np.int64))

    def classes(pairs):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            low, high = sorted((find(x), find(y)))
            root[high] = low
        return {f: find(f) for f in root}

    every = [(x, y) for i, x in enumerate(fps.tolist()) for y in fps[i + 1 :].tolist() if bin(x ^ y).count("1") <= 4]
    assert classes(zip(a.tolist(), b.tolist(), strict=True)) == classes(every)


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    fps[70] = fps[3] ^ np.uint64(0b10111)
    fps[71] = fps[3] ^ np.uint64(0b111110)
    q, blocks = np.repeat(fps, 3), np.tile(np.arange(3), 130)
    live, hit = simhash.near_lanes(q[:, None], blocks, simhash.planes(fps[:, None]))
    got = {(int(e) // 3, int(e) % 3 * 64 + lane) for e, h in zip(live, hit.tolist(), strict=True) for lane in range(64) if h >> lane & 1 and int(e) % 3 * 64 + lane < 130}
    assert got == {(i, j) for i in range(130) for j in range(130) if bin(int(fps[i] ^ fps[j])).count("1") <= 4}


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    chain = [(1 << i) - 1 for i in range(60)]
    rows = spark.createDataFrame([(c, c) for c in chain], "node long, w0 long")
    links = simhash.near_links(rows, len(chain), simhash.key_scheme(len(chain))).collect()
    root = {c: c for c in chain}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in links:
        root[find(r["src"])] = find(r["dst"])
    assert len({find(c) for c in chain}) == 1


def test_borders_resist_shifts():
    data = prose(4, 3000).encode()
    assert b"".join(data[s:e] for s, e in zip([0, *chunks.borders(data)], chunks.borders(data), strict=False)) == data
    cut = {data[s:e] for s, e in zip([0, *chunks.borders(data)], chunks.borders(data), strict=False)}
    moved = b"some words before " + data[:9000] + b"an insertion" + data[9000:]
    ends = chunks.borders(moved)
    kept = sum(e - s for s, e in zip([0, *ends], ends, strict=False) if moved[s:e] in cut)
    assert kept > 0.95 * len(data) and np.diff([0, *ends]).max() <= chunks.MOST


def plain_borders(data):
    """The border rule of chunks, byte by byte."""
    g, full, n, reach = chunks.gear_table().tolist(), (1 << 32) - 1, len(data), chunks.REACH
    h = [sum(g[data[i - k]] << k for k in range(min(chunks.WINDOW, i + 1))) & full for i in range(n)]
    least = [i + 1 for i in range(reach, n - reach) if h[i] == min(h[i - reach : i + reach + 1])]
    kept = []
    for e in least:
        if not kept or e - kept[-1] > reach:
            kept.append(e)
    out, last = [], 0
    for e in [*kept, *([n] if n else [])]:
        out += [*range(last + chunks.MOST, e, chunks.MOST), e]
        last = e
    return out


@pytest.mark.parametrize("text", ["", "short", "x" * 700, "ab " * 300, prose(3, 200), "é中😀 " * 50 + prose(1, 40)])
def test_borders_by_hand(text):
    assert chunks.borders(text.encode()).tolist() == plain_borders(text.encode())


def test_repeats(spark, odd, tables):
    rows = op7_chunks(spark, tables).collect()
    assert {r["doc_id"] for r in rows} >= {3, 20, 21}
    shared = " ".join(f"w{i}q{i * 7 % 13}" for i in range(60))
    docs = spark.createDataFrame([(i, prose(50 + i, 400) + " " + (shared if i in (2, 5, 9) else "") + " " + prose(90 + i, 300)) for i in range(12)] + [(20, None), (21, "")], "doc_id long, text string")
    varied = docs.withColumn("text", F.regexp_replace("text", "([a-z]+)", F.concat(F.lit("$1"), F.col("doc_id").cast("string"))))
    varied = docs.select("doc_id", F.when(F.col("doc_id").isin(2, 5, 9), F.concat(F.repeat(F.sha2(F.col("doc_id").cast("string"), 256), 4), F.lit(shared), F.repeat(F.sha2(F.concat("doc_id", F.lit("z")), 256), 3))).otherwise(F.sha2(F.col("doc_id").cast("string"), 512)).alias("text"))
    found = chunks.repeats(varied).collect()
    assert {r["doc_id"] for r in found} == {2, 5, 9}
    assert {r["first_doc_id"] for r in found} == {2} and {r["doc_id"] for r in found if r["removable"]} == {5, 9}
    text = {r["doc_id"]: r["text"] for r in varied.collect()}
    for r in found:
        assert text[r["doc_id"]].encode()[r["start"] : r["end"]].decode() in text[2]


def test_without_repeats(spark):
    rows = spark.createDataFrame([("abécdef", [(2, 5)]), ("keep", [])], "t string, s array<struct<start:long,end:long>>")
    assert [r[0] for r in rows.select(chunks.without_repeats(F.col("t"), F.col("s"))).collect()] == ["abdef", "keep"]


def test_empty_tables(spark, empty_tables, none):
    for query in (op1_quality, op4_fingerprints, op5_packing, op6_simhash, op7_chunks, op9_language):
        assert query(spark, empty_tables).count() == 0
    assert simhash.drop_near_copies(none).count() == 0


def test_pipeline_stages(spark, tables, empty_tables):
    """Each stage against what its operator says of its input; the run packs what the mix took."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), stage(spark, docs, tables).schema)
        if k < 4:
            assert docs.columns == before.columns, name
        if name == "quality rules":
            assert all(len(WORD.findall(r["text"])) >= 50 for r in docs.collect())
        if name == "simhash near-dedup":
            fps = [plain_simhash(r["text"]) for r in docs.collect() if r["doc_id"] is not None]
            assert all(bin(a ^ b).count("1") > 4 for i, a in enumerate(fps) for b in fps[i + 1 :])
        if name == "best-fit packing":
            check_packing(docs.collect(), collections.Counter((r["doc_id"], r["text"] or "") for r in before.collect()))
    assert corpus_pipeline.run(spark, tables).count() == docs.count()
    assert corpus_pipeline.run(spark, empty_tables).count() == 0
