"""Whole results against plain Python: scores, spans, likeness, walks, stages; and ids that no double holds."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import chunks, fingerprints, language, licenses, mixing, packing, quality_qda, quality_rules, secrets, simhash
from flowlens.llm.queries import op1_quality, op4_fingerprints, op5_packing, op6_simhash, op7_chunks, op9_language

from .conftest import SCHEMA, prose
from .test_native import plain_targets
from .test_python import WORD, check_packing, plain_borders

BIG = (1 << 53) + 1


@pytest.fixture(scope="module")
def large_ids(spark, tmp_path_factory):
    """Ids above 2**53 beside a null, some repeated, in one partition."""
    docs = [(BIG, prose(1, 80)), (BIG + 2, prose(1, 80)), (None, prose(2, 90)), (BIG + 4, None), (BIG + 4, prose(3, 1500)), (-BIG, ""), ((1 << 63) - 1, prose(4, 70)), (BIG, prose(1, 80))]
    rows = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in docs], SCHEMA).coalesce(1)
    path = str(tmp_path_factory.mktemp("large"))
    rows.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(BIG, 1), (BIG + 2, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path, [d for d, _ in docs]


@pytest.mark.parametrize("query", [op1_quality, op4_fingerprints, op6_simhash, op9_language])
def test_ids_stay_whole(spark, large_ids, query):
    path, ids = large_ids
    assert collections.Counter(r["doc_id"] for r in query(spark, path).collect()) == collections.Counter(ids)


def test_ids_stay_whole_in_pieces_and_chunks(spark, large_ids):
    path, ids = large_ids
    rows = op5_packing(spark, path).collect()
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == collections.Counter(ids)
    found = {r["doc_id"] for r in op7_chunks(spark, path).collect()}
    assert found == {BIG, BIG + 2}
    assert {r["component_id"] for r in op6_simhash(spark, path).where(f"doc_id = {BIG + 2}").collect()} == {BIG}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for stage in (corpus_pipeline.dedup_stage, corpus_pipeline.secrets_stage, corpus_pipeline.mixing_stage):
        assert {r["doc_id"] for r in stage(spark, docs, path).collect()} <= set(ids)


def test_quality_scores_by_hand(spark, odd, labels):
    """Means, shrunk covariances and scores from rows, with numpy alone."""
    rows = [(r["doc_id"], np.rint(np.array(quality_qda.statistics(r["text"])) * 4096) / 4096) for r in odd.select("doc_id", "text").collect()]
    seen = collections.defaultdict(set)
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            seen[r["doc_id"]].add(r["quality"])
    one = {d: min(q) for d, q in seen.items() if len(q) == 1}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    x = {k: np.array([v for d, v in rows if one.get(d) == k and not held(d)]) for k in (0, 1)}
    n = {k: len(x[k]) for k in x}
    cov = {k: np.cov(x[k].T, bias=True) for k in x}
    both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    logs = {}
    for k in x:
        s = 0.9 * cov[k] + 0.1 * both
        s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s))
        inverse, det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        logs[k] = {d if d is not None else (None, i): math.log(n[k] / (n[0] + n[1])) - 0.5 * ((v - x[k].mean(axis=0)) @ inverse @ (v - x[k].mean(axis=0)) + det) for i, (d, v) in enumerate(rows)}
    for r in quality_qda.score_quality(odd, labels).where("doc_id is not null").collect():
        gap = (logs[0][r["doc_id"]] - logs[1][r["doc_id"]]) / quality_qda.HEAT
        assert r["score"] == pytest.approx(1 / (1 + math.exp(min(max(gap, -500), 500))), abs=1e-6)


def plain_grams(text):
    t = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    if not t.strip():
        return []
    found = collections.Counter(c for c in t if c != " ")
    found.update(t[i : i + 2] for i in range(len(t) - 1))
    found.update(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(found, key=lambda g: (-found[g], code(g))), found, code


def test_languages_by_hand(odd):
    """Profiles, distances and predictions of every row."""
    rows = odd.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    learned = collections.defaultdict(collections.Counter)
    for r in rows:
        if not held(r["doc_id"]) and r["lang"] is not None and plain_grams(r["text"] or ""):
            learned[r["lang"]].update(plain_grams(r["text"] or "")[1])
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    rank = {k: {g: i for i, g in enumerate(sorted(v, key=lambda g: (-v[g], code(g)))[:400])} for k, v in learned.items()}
    want = collections.Counter()
    for r in rows:
        grams = plain_grams(r["text"] or "")
        if not grams:
            want[(r["doc_id"], "und", 0.0)] += 1
            continue
        far = sorted((sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(grams[0][:300])), k) for k, p in rank.items())
        want[(r["doc_id"], far[0][1], (far[1][0] - far[0][0]) / far[1][0])] += 1
    assert collections.Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd).collect()) == want


@pytest.mark.parametrize("run", [1, 100, 400])
def test_repeats_by_hand(odd, run):
    """Every run of repeated chunks, whatever its length."""
    rows = odd.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).collect()
    texts, ids = {r["row"]: (r["text"] or "").encode() for r in rows}, {r["row"]: r["doc_id"] for r in rows}
    pieces, places = {}, collections.defaultdict(list)
    for row, data in texts.items():
        ends = plain_borders(data)
        pieces[row] = list(zip([0, *ends], ends, strict=False))
        for i, (s, e) in enumerate(pieces[row]):
            places[data[s:e]].append((ids[row] is None, ids[row] or 0, row, i))
    want = collections.Counter()
    for row, data in texts.items():
        islands, now = [], []
        for i, (s, e) in enumerate([*pieces[row], (0, 0)]):
            at = places.get(data[s:e], [])
            if e > s and len({p[2] for p in at}) > 1:
                now.append((s, e, min(at)))
            elif now:
                islands.append(now)
                now = []
        for island in islands:
            if island[-1][1] - island[0][0] < run:
                continue
            parts = [[island[0]]]
            for x in island[1:]:
                same = mine_first(x, row, pieces) == mine_first(parts[-1][-1], row, pieces)
                (parts[-1].append(x) if same else parts.append([x]))
            for p in parts:
                first = p[0][2]
                want[(ids[row], row, p[0][0], p[-1][1], len(p), None if first[0] else first[1], not mine_first(p[0], row, pieces))] += 1
    got = collections.Counter((r["doc_id"], r["row"], r["start"], r["end"], r["n_chunks"], r["first_doc_id"], r["removable"]) for r in chunks.repeats(odd, run).collect())
    assert got == want


def mine_first(chunk, row, pieces):
    """Whether the first of all places of a chunk is this one."""
    return chunk[2][2] == row and pieces[row][chunk[2][3]] == chunk[:2]


def test_passages_of_fifty_words_are_found():
    """Passages of 51 words set into other texts share a run that is reported, periodic ones included."""
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    cut_up = lambda t: [t.encode()[s:e] for s, e in zip([0, *chunks.borders(t.encode())], chunks.borders(t.encode()), strict=False)]
    for k in range(300):
        passage = text(51) if k % 10 else (r.choice(words) + " ") * 60
        a, b = (cut_up(f"{text(r.randint(0, 80))} {passage} {text(r.randint(0, 80))}") for _ in range(2))
        best = now = 0
        for c in a:
            now = now + len(c) if c in b else 0
            best = max(best, now)
        assert best >= chunks.RUN, passage


def plain_walk(rows, near=mixing.NEAR):
    """Copies of each row by walking sources document by document."""
    by, sizes = collections.defaultdict(list), collections.Counter()
    for d, t, s in rows:
        t = t or ""
        n = len(WORD.findall(t))
        h = int(hashlib.md5(f"{'' if d is None else d}|{t}".encode()).hexdigest()[:15], 16)
        clean = 1 - sum(t.count(c) for c in mixing.UNCLEAN) / max(len(re.sub(r"[\x20\x09-\x0D]", "", t)), 1)
        sizes[s] += n
        by[s].append((math.log(-math.log((h // 256 + 0.5) / 2**52)) - math.log(max(clean * clean, 0.05)), h, n, d))
    out = collections.Counter()
    for s, target in plain_targets(dict(sizes)).items():
        epochs = min(3, int(target // sizes[s])) if sizes[s] else 0
        left, held = target - epochs * sizes[s], []
        for _, h, n, d in sorted(by[s], key=lambda x: x[:2]):
            take = left > near * target and n <= left
            left -= n * take
            held.append([d, h, n, epochs + take])
        if left > near * target:
            for x in held:
                if x[3] == epochs and x[2] < 2 * left:
                    x[3] += 1
                    break
        out.update(map(tuple, held))
    return out


def test_mix_is_the_walk(spark, odd):
    r = random.Random(8)
    many = [(i, " ".join(["w#1"[: 1 + i % 3]] * r.choice([0, 1, 2, 5, 40, 300])), "abc"[i % 3] if i % 7 else None) for i in range(400)]
    for rows in ([(x["doc_id"], x["text"], x["source"]) for x in odd.collect()], many):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        assert collections.Counter((x["doc_id"], x["h"], x["size"], x["copies"]) for x in mixing.mix(docs).collect()) == plain_walk(rows)


def test_no_bucket_is_hot_at_low_weight(spark):
    """Documents of weight 0.05 fall into as many buckets as others."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("#### 1").alias("text"), F.lit("a").alias("source"))
    keyed = mixing._keyed(rows, F.lit(1), F.lit(0.05)).groupBy(F.floor(F.col("key") * mixing.FINE).alias("f")).count()
    assert keyed.agg(F.max("count")).first()[0] <= 12


def test_repeats_of_a_labelled_text_are_one_trial(spark):
    good = prose(1, 80)
    docs = spark.createDataFrame([(i, good, "en", "a", 0) for i in range(200)] + [(300 + i, prose(i + 5, 70), "en", "a", 0) for i in range(10)], SCHEMA)
    marks = spark.createDataFrame([(i, 1) for i in range(200)] + [(300 + i, 1) for i in range(10)], "doc_id long, quality int")
    assert quality_rules.labelled_texts(quality_rules.measured(docs), marks).count() == 11


LOWERS = "abcdefghijklmnopqrstuvwxyz"
UPPERS, NUMBERS, HEXES = LOWERS.upper(), "0123456789", "0123456789abcdef"


def random_kinds(r):
    s = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    every = LOWERS + UPPERS + NUMBERS
    return {
        "alphanumeric 40": lambda: s(every, 40), "alphanumeric 20": lambda: s(every, 20), "alphanumeric 16": lambda: s(every, 16), "base32": lambda: s(UPPERS + "234567", 32),
        "uuid": lambda: "-".join(s(HEXES, n) for n in (8, 4, 4, 4, 12)), "prefixed": lambda: "sk_live_" + s(every, 24), "upper hex": lambda: s(HEXES.upper(), 40), "letters 20": lambda: s(LOWERS + UPPERS, 20),
        "letters 40": lambda: s(LOWERS + UPPERS, 40), "lower 32": lambda: s(LOWERS, 32), "base64": lambda: s(every + "+/", 44), "upper 20": lambda: s(UPPERS, 20),
    }


def plain_kinds(r):
    """Names, paths and addresses of words that are no part of the samples."""
    names = "invoice customer address shipping payment account balance currency region supplier lineitem priority river garden engine cloud forest bridge stone".split()
    w = lambda n: [r.choice(names) for _ in range(n)]
    return {
        "path": lambda: "/".join(w(5)) + f"/{r.randrange(99)}.html", "snake": lambda: "_".join(w(3)) + f"_{r.randrange(2030)}", "camel": lambda: "".join(x.capitalize() for x in w(4)), "constant": lambda: "_".join(w(3)).upper(),
        "kebab": lambda: "-".join(w(4)), "url": lambda: "https://www.example.org/" + "/".join(w(3)) + "/" + "-".join(w(3)), "dated": lambda: f"{w(1)[0]}/2024/{r.randrange(10, 13)}/{r.randrange(10, 29)}/" + "-".join(w(4)), "number": lambda: "".join(r.choice(NUMBERS) for _ in range(18)),
    }


def test_random_strings_are_found_and_words_are_not(spark):
    """Recall of the Markov test on each kind of random string, and its false alarms on names and paths, none of which it was trained on."""
    r = random.Random(4)
    made = [(kind, bad, f()) for kinds, bad in ((random_kinds(r), True), (plain_kinds(r), False)) for kind, f in kinds.items() for _ in range(200)]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, (_, _, t) in enumerate(made)], "doc_id long, text string")
    found = {x["doc_id"] for x in secrets.scan_secrets(docs).where(F.size("spans") > 0).collect()}
    hits = collections.Counter(made[i][0] for i in found)
    assert all(hits[kind] >= 180 for kind in random_kinds(r)), hits
    assert sum(hits[kind] for kind in plain_kinds(r)) <= 0.01 * 200 * len(plain_kinds(r)), hits


def test_lower_case_letters_alone(spark):
    """The hardest kind, 16 lower-case letters: most are found; words of a language, joined, are mostly not."""
    r = random.Random(5)
    rand = ["".join(r.choice(LOWERS) for _ in range(16)) for _ in range(300)]
    words = "invoice customer address shipping payment account balance currency region supplier priority river garden engine cloud forest bridge stone".split()
    plain = ["".join(r.choice(words) for _ in range(3)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rand + plain)), "doc_id long, text string")
    found = [x["doc_id"] for x in secrets.scan_secrets(docs).where(F.size("spans") > 0).collect()]
    assert sum(d < 300 for d in found) >= 255 and sum(d >= 300 for d in found) <= 6


def test_a_random_stretch_is_found_in_a_long_path(spark):
    """An ordinary prefix or suffix does not dilute what is random."""
    r = random.Random(6)
    key = "".join(r.choice(LOWERS + UPPERS + NUMBERS) for _ in range(24))
    docs = spark.createDataFrame([(1, "/usr/share/" + "river/" * 40 + key + "/garden" * 40), (2, "/usr/share/" + "river/" * 40 + "/garden" * 40)], "doc_id long, text string")
    assert [x["doc_id"] for x in secrets.scan_secrets(docs).where(F.size("spans") > 0).collect()] == [1]


def test_shorter_tokens_by_parameter(spark):
    docs = spark.createDataFrame([(1, "see aZ3kQ9xW7bT2m here")], "doc_id long, text string")
    count = lambda **kw: secrets.scan_secrets(docs, **kw).select(F.size("spans")).first()[0]
    assert count() == 0 and count(shortest=12) == 1


def test_spans_take_many_matches(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "token = abcdefgh é " * n, 0)], "doc_id long, text string, n_chars long")
    row = secrets.scan_secrets(docs).select(F.size("spans").alias("n"), F.element_at("spans", -1)["start"].alias("last")).first()
    assert (row["n"], row["last"]) == (n, 19 * (n - 1))
    assert secrets.redact(docs).first()["text"] == "[secret] é " * n
    many = spark.createDataFrame([(1, "under the MIT License. " * n)], "doc_id long, text string")
    assert licenses.scan_licenses(many).select(F.size("detections"), F.size("base")).first()[:] == (n, n)


def test_packing_in_groups(spark):
    docs = spark.createDataFrame([(i, prose(i, 5 + i * 37 % 400), "en", "a", 0) for i in range(120)], SCHEMA)
    import public_tokenizers

    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), group=30).collect()
    check_packing(rows, collections.Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    assert len({r["sequence_id"] >> 24 for r in rows}) == round(len(rows) / 30)


def test_no_step_is_left(spark):
    """After the search no move, one-for-one or two-for-one exchange raises the squares."""
    rng = np.random.default_rng(2)
    for cap in (20, 50):
        lengths = rng.integers(1, cap + 1, 60)
        bins = packing.improve(lengths, packing.best_fit(lengths, cap), cap)
        fill = np.bincount(bins, weights=lengths).astype(int)
        if np.count_nonzero(fill) <= -(-lengths.sum() // cap):
            continue
        for v in set(bins.tolist()):
            own = np.flatnonzero(bins == v)
            for gone in [[i] for i in own] + [[i, j] for a, i in enumerate(own) for j in own[a + 1 :]]:
                for back in [None, *np.flatnonzero(bins != v)]:
                    gain = lengths[gone].sum() - (lengths[back] if back is not None else 0)
                    for t in [bins[back]] if back is not None else (set(bins.tolist()) - {v} if len(gone) == 1 else ()):
                        full = fill[v] == cap or fill[t] == cap
                        assert full or gain <= 0 or fill[t] + gain > cap or fill[t] + gain <= fill[v]


def edit(text, share, seed):
    """The text with that share of its words replaced, in one stretch."""
    w = text.split()
    k = max(1, round(len(w) * share))
    at = random.Random(seed).randrange(len(w) - k)
    return " ".join(w[:at] + [f"new{seed}x{i}" for i in range(k)] + w[at + k :])


def test_near_copies_of_the_stage(spark):
    """Copies of shingle similarity 0.8 and more go, of 0.5 and less stay, at the stage's own parameters."""
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    base = [" ".join(r.choice(words) for _ in range(200)) for _ in range(100)]
    near = [edit(t, 0.06, i) for i, t in enumerate(base)]  # about 16 of 196 shingles differ on each side: 0.85
    far = [edit(t, 0.4, i) for i, t in enumerate(base)]
    docs = spark.createDataFrame([(k * 1000 + i, t, "en", "a", 0) for k, group in enumerate((base, near, far)) for i, t in enumerate(group)], SCHEMA)
    kept = {x["doc_id"] for x in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert {d for d in kept if d < 1000} == set(range(100))
    assert len([d for d in kept if 1000 <= d < 2000]) <= 5
    assert {d for d in kept if d >= 2000} == set(range(2000, 2100))


def test_wide_links_are_the_pairs_within_the_radius():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    flips = np.zeros((40, 4), np.uint64)
    for i in range(40):
        for b in rng.choice(256, 10 + 2 * i, replace=False):
            flips[i, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    fps = np.concatenate([base, base ^ flips])
    radius = simhash.wide_radius(0.8, 4)
    a, b = simhash.links_within(np.zeros(80, np.int64), np.arange(80), fps, np.zeros(80, np.int64), radius)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == {(i, 40 + i) for i in range(40) if 10 + 2 * i <= radius}


def test_next_of_texts_that_share_an_id(spark):
    """Ids of any type; a hot id is dealt out over buckets and loses no row."""
    rows = [("k", f"text {i} " + prose(i, 20)) for i in range(60)] + [(None, prose(i, 10)) for i in range(20)] + [("a", None), ("z", "last")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    made = fingerprints.edit_likeness(docs, buckets=8).collect()
    assert collections.Counter(r["doc_id"] for r in made) == collections.Counter(d for d, _ in rows)
    sizes = fingerprints.in_sequence(docs, 8).where("late = 0").groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) < 40


def test_stages_by_hand(spark, tables):
    """Rules, secrets and mixing of the pipeline, each on what the stage before it left, against plain versions."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = quality_rules.quality_rules(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()
    kept = corpus_pipeline.rules_stage(spark, docs, tables)
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in rows if r["kept"])
    marked = kept.withColumn("text", F.concat("text", F.lit(' token = "abcdefgh" ')))
    clean = {(r["doc_id"], r["text"]) for r in corpus_pipeline.secrets_stage(spark, marked, tables).collect()}
    assert clean == {(r["doc_id"], r["text"].replace('token = "abcdefgh', "[secret]")) for r in marked.collect()}
    copies = plain_walk([(r["doc_id"], r["text"], r["source"]) for r in kept.collect()])
    want = collections.Counter()
    for (d, _, _, n), rows_ in copies.items():
        want[d] += n * rows_
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, kept, tables).collect()) == +want
