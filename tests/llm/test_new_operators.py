"""Top-k search, phrase collocations and conversation repair against brute force, and over awkward tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import collocations, conversations, metric_tree

from .conftest import CLASHES, rows


# ---- top-k

def brute_top(data, k=10):
    good = [(i, v) for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in good]
    out = []
    for a, (q, u) in enumerate(whole):
        if q is None or q % 100:
            continue
        best = sorted((-sum(x * y for x, y in zip(u, v)), i is None, i or 0, i) for b, (i, v) in enumerate(whole) if b != a)[:k]
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(best)]
    return collections.Counter(out)


def vectors(spark, data):
    extra = ", ".join(c for c in CLASHES.split(", ") if c.split()[0] not in ("doc_id",))
    made = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    return made.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in extra.split(", ")])


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_top_k_is_brute_force(spark, scale):
    r = np.random.default_rng(3)
    data = [(i, (r.normal(size=8) * (1 + i % 5) * scale).tolist()) for i in range(1500)]
    data += [(2000 + i, data[100][1]) for i in range(300)] + [data[200], data[200], (None, data[7][1]), (None, [1.0])]
    data += [(3000, None), (3100, [1.0, None]), (3200, [float("nan")] * 8), (3300, [float("inf")] * 8), (3400, []), (3500, [0.0] * 8), (3600, [0.5, -0.5])]
    got = collections.Counter(map(tuple, metric_tree.top_k(vectors(spark, data), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute_top(data)


def test_top_k_of_few_and_none(spark):
    assert metric_tree.top_k(vectors(spark, [(1, [1.0])]).where("false"), F.lit(True)).count() == 0
    assert metric_tree.top_k(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert collections.Counter(map(tuple, metric_tree.top_k(vectors(spark, few), F.col("vec_id") % 100 == 0).collect())) == brute_top(few)
    with pytest.raises(Exception, match="do not fit"):
        metric_tree.top_k(vectors(spark, [(0, [1e14]), (1, [1e14])]), F.lit(True)).collect()


def test_equal_vectors_fill_no_subtree(spark, monkeypatch):
    """A vector that a third of all rows repeat is dealt over subtrees; what a subtree holds keeps its bound."""
    monkeypatch.setattr(metric_tree, "ROUTED", 50)
    r = np.random.default_rng(1)
    data = [(i, r.normal(size=6).tolist() if i % 3 else [0.25] * 6) for i in range(3000)]
    index = metric_tree.build(metric_tree.whole_vectors(vectors(spark, data)))
    sizes = [x[0] for x in index.pages.groupBy("tree").agg(F.sum(F.size("uids")).alias("n")).where("n > 0").select("n").collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2 * max(100, 2 * 3000 // len(index.pivots))
    got = collections.Counter(map(tuple, metric_tree.top_k(vectors(spark, data), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute_top(data)


def test_bounds_spare_distances():
    """In clustered data most distances are never computed; radii and stored distances hold."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    v = np.floor(1024 * (r.normal(size=(40, 5))[r.integers(0, 40, 4000)] + 0.02 * r.normal(size=(4000, 5))))
    space = metric_tree.Space(5, float((v * v).sum(axis=1).max()))
    pages = metric_tree.build_pages(v, space)
    points = space.lifted(v)
    below = {}
    for p in reversed(range(len(pages))):
        page = pages[p]
        below[p] = page["entries"] if page["leaf"] else np.concatenate([below[q] for q in page["entries"]])
        assert (space.apart(points[below[p]], points[page["centre"]]) <= page["radius"] + 1e-9).all() and len(page["entries"]) <= metric_tree.PAGE
    assert sorted(below[0].tolist()) == list(range(4000))
    table = pa.table({"v": pa.array(list(v)), "uid": pa.array(range(4000)), "vec_id": pa.array(range(4000))})
    tree = metric_tree.Tree(metric_tree._pages_of(space)((pa.scalar(1),), table), space)
    for i in range(0, 4000, 100):
        best = tree.search(v[i], i, 10, -np.inf)
        s = v @ v[i]
        want = [j for j in np.lexsort((np.arange(4000), -s)) if j != i][:10]
        assert [(b[0], b[2]) for b in best] == [(s[j], j) for j in want]
    assert tree.computed < 40 * 4000 / 4


# ---- phrases

def brute_phrases(data, top=2000):
    words, count = collections.Counter(), collections.Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in (1, 2, 3):
                count.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    found = {p: a for p, a in count.items() if len(p) > 2 and a >= 10}
    out = collections.defaultdict(list)
    for p, a in found.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[1:][i : i + len(w)] == w for i in range(len(q) - len(w))) for q, b in found.items()):
            continue
        score, k = min((1_000_000 * a * a // (count[lang, *w[:k]] * count[lang, *w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), count[lang, *w[:k]], count[lang, *w[k:]]))
    return {(lang, r + 1, p.decode(), -a, x, y, words[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def phrase_rows():
    r = random.Random(2)
    vocabulary = ["a", "B", "cc", "dé", "中文", "e-f", "g\x00h", " ", "x'", "The"]
    data = [(("en", "de", None, "und")[i % 4], "".join(r.choices(vocabulary, [9, 7, 5, 4, 3, 3, 2, 2, 1, 1])[0] + r.choice([" ", " ", "\t", "  ", ", ", ".\n"]) for _ in range(120))) for i in range(60)]
    return data + [("en", None), ("fr", ""), ("fr", " \t "), ("fr", "one two three"), ("it", "la la la la " * 20), ("it", "z y. " * 10), ("it", "w" * 100_000)]


def test_phrases_are_brute_force(spark):
    data = phrase_rows()
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in data], "lang string, text string, n int").repartition(5)
    got = collocations.collocations(docs)
    assert got.dtypes == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert {tuple(x) for x in got.collect()} == brute_phrases(data)


def test_phrases_do_not_depend_on_the_order_of_words(spark, monkeypatch):
    """One bucket for all words (the order is then a hash), slices of a text each, split pivots: the same counts."""
    data = phrase_rows()
    want = brute_phrases(data)
    docs = spark.createDataFrame(data, "lang string, text string").repartition(5)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = collocations.word_counts(rows).where("f >= 10")
    for table, most in ((collocations.order_table(words), 3), (np.full(collocations.BUCKETS, 10**6), 10**9)):
        found = collocations.mine(collocations.fragments(rows, table, most)).collect()
        assert {(x["lang"], " ".join(filter(None, (x["x"], x["y"], x["z"])))): x["a"] for x in found}.items() >= {(x[0], x[2]): x[3] for x in want}.items()


@pytest.mark.parametrize("size", [1, 300, 5000])
def test_slices_count_as_the_whole(monkeypatch, size):
    """Texts cut up in slices of a batch have the words of the whole batch."""
    import pyarrow as pa

    data = [(lang or "und", text or "") for lang, text in phrase_rows()]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in data]), pa.array([x[1] for x in data])], ["lang", "text"])

    def counted(limit):
        monkeypatch.setattr(collocations, "SLICE", limit)
        out, n = collections.Counter(), 0
        for part in collocations._slices(batch):
            entry, lang, word, _ = collocations.cut_up(part)
            n += 1
            for k in entry[entry >= 0].tolist():
                out[lang[k].as_py(), word[k].as_py()] += 1
        return out, n

    (whole, one), (cut_up, many) = counted(1 << 30), counted(size)
    assert whole == cut_up and one == 1 and many > 1


def test_phrases_top_long_and_none(spark):
    data = [("en", f"w{i} v{i}. " * 12) for i in range(30)]
    docs = spark.createDataFrame(data, "lang string, text string")
    assert {tuple(x) for x in collocations.collocations(docs, top=7).collect()} == brute_phrases(data, 7)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.limit(1).select(F.lit("x").alias("lang"), F.lit(None).cast("string").alias("text"))).count() == 0


def test_phrases_of_the_awkward_table(odd):
    want = brute_phrases([(r[2], r[1]) for r in rows()])
    assert {tuple(x) for x in collocations.collocations(odd).collect()} == want


# ---- conversations

GRAMMAR = re.compile("(s?(ua)+)?")


def every_edit(rows):
    """Least (cost, audit) by trying all edits; rows: (initial, fault)."""
    best = (10**9, "")
    n = len(rows)

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == n and GRAMMAR.fullmatch(roles):
            best = min(best, (cost, audit))
        if inserted < 3:
            for x in "ua":
                go(i, cost + 2, audit + "I", roles + x, inserted + 1)
        if i < n:
            initial, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", roles, 0)
            if fault not in (1, 2):
                if initial:
                    go(i + 1, cost + (fault == 3), audit + "K", roles + initial, 0)
                for x in "ua":
                    go(i + 1, cost + 2 + (fault == 3), audit + "R", roles + x, 0)

    go(0, 0, "", "", 0)
    return best


def test_shortest_path_is_every_edit():
    r = random.Random(6)
    for n in (0, 1, 2, 3, 4):
        for _ in range(60):
            rows = [(r.choice("suauax"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            want = every_edit(rows)
            assert conversations.best_edits(rows) == want, rows
            assert conversations.joined([conversations.block_matrix([x]) for x in rows]) == want


def test_blocks_join():
    r = random.Random(7)
    for _ in range(200):
        rows = [(r.choice("sssuauaux"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randrange(40))]
        size = r.randrange(1, 9)
        assert conversations.joined([conversations.block_matrix(rows[i : i + size]) for i in range(0, len(rows), size)]) == conversations.best_edits(rows)


def brute_repair(data):
    space = lambda x: " " if x is None else x
    talks = collections.defaultdict(list)
    for conv, turn, role, text in data:
        code = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        talks[conv]
        if code == 0:
            continue
        role, text = ("user" if code == 4 else space(role)), space(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        talks[conv] += [(turn, role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, rows in talks.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:200].encode(), hashlib.sha256(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, audit = conversations.best_edits(list(zip(initials, faults)))  # held against every edit above
        kept, at, odd = [], iter(rows), (len(audit) - audit.count("D")) % 2
        names = itertools.chain(["system"] if odd else [], itertools.cycle(["user", "assistant"]))
        for e in audit:
            row = None if e == "I" else next(at)
            if e != "D":
                name = next(names)
                kept.append(f"{row[1] if e == 'K' else name}:{row[2] if row else ''}")
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def talk_rows():
    r = random.Random(8)
    texts = ["Yes.", "No?", "well", " \t\n", "", None, "Fine! \n", "é!", "x" * 300 + ".", "x" * 300 + "?"]
    data = [(c, t + (t > 4), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts) if r.random() < 0.4 else f"Text {r.random()}.") for c in range(60) for t in range(r.randrange(1, 9))]
    data += [(None, i, r.choice(["user", "assistant"]), f"t {i % 40}.") for i in range(150)] + [(70, None, "user", "a."), (70, None, None, None), (70, 3, "assistant", "b"), (71, 1 << 60, "user", "c.")]
    return data + [(72, 2, "user", f"same turn {i % 3}.") for i in range(20)] + [(73, 5, "user", "Again.")] * 300 + [(74, 1, "system", "y" * 500_000 + ".")]


@pytest.mark.parametrize("block", [3, conversations.BLOCK])
def test_repair_is_brute_force(spark, block):
    data = talk_rows()
    made = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    made = made.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHES.split(", ")])
    got = conversations.repair(conversations.damage(made), here="here", block=block)
    assert collections.Counter(map(tuple, got.collect())) == brute_repair(data)


def test_repair_of_none(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(none), here="here").count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    row = spark.createDataFrame([(dropped, 1, "user", "Gone.")], none.schema)
    assert conversations.repair(conversations.damage(row), here="here").first()[:] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(row).first()["audit"] == "KI"
