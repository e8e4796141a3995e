"""Figures of op1 and op4 against plain Python that shares no code with them."""

from __future__ import annotations

import collections
import math
import random

import pytest

from flowlens.llm import fingerprints, quality_qda

from .conftest import prose, rows

BLANK = " \t\n\x0b\f\r"


def words_of(text):
    out, word = [], ""
    for c in text:
        if c in BLANK:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def plain_statistics(text):
    text = text or ""
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    words, n = words_of(text), size(text)
    ink = max(sum(size(w) for w in words), 1)
    lines = [x for x in text.split("\n") if words_of(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    bytes_ = collections.Counter(text.encode("utf-8", "surrogatepass"))
    logit = lambda x: math.log((x + 0.002) / (1 - min(x, 0.999) + 0.002))
    part = lambda test: logit(sum(k for b, k in bytes_.items() if test(b)) / ink)
    marks = {c for c in range(33, 127) if not chr(c).isalnum()} - set(b"#*$%&|<>!?.,;:")
    return {
        "chars": math.log(1 + n), "words": math.log(1 + len(words)), "word_len": math.log(1 + ink / max(len(words), 1)), "long_word": math.log(1 + max([size(w) for w in words], default=0)),
        "variety": len(set(words)) / math.sqrt(max(len(words), 1)) / 10, "repeats": logit((len(triples) - len(set(triples))) / len(triples) if triples else 0.0), "dup_lines": logit((len(lines) - len(set(lines))) / len(lines) if lines else 0.0),
        "line_words": math.log(1 + len(words) / max(len(lines), 1)), "upper": part(lambda b: 65 <= b <= 90), "digits": part(lambda b: 48 <= b <= 57), "symbols": part(lambda b: b in b"#*$%&|<>"), "bangs": part(lambda b: b in b"!?"),
        "stops": part(lambda b: b in b".,;:"), "other": part(lambda b: b in marks), "wide": part(lambda b: b > 127), "entropy": -sum(k / n * math.log(k / n) for k in bytes_.values()) if n else 0.0,
    }


def test_quality_statistics_are_plain(spark):
    r = random.Random(1)
    texts = [t for _, t, *_ in rows()] + ["".join(r.choice("aB9# .,!?\n\té中") for _ in range(r.randrange(200))) for _ in range(40)] + ["same line\nsame line\nother !!\n\n", "a b c a b c a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["x"] for x in quality_qda.document_statistics(docs).collect()}
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        assert got[i] == pytest.approx([want[c] for c in quality_qda.FEATURES], abs=1.01 / quality_qda.GRAIN), (i, (t or "")[:40])


def test_likeness_figures_are_counts_of_sets(spark):
    """For texts of fewer shingles than a sketch holds, every figure is that of the sets themselves."""
    texts = [prose(i, n) for i, n in enumerate((40, 80, 80, 3, 0, 120, 100))] + [prose(1, 80), "", None, prose(1, 79) + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def shingles(t):
        w = words_of(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for x in fingerprints.edit_likeness(docs).collect():
        own = texts[x["doc_id"]] or ""
        following = texts[(x["doc_id"] + 1) % len(texts)] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + following[:cut]
        a, b, c = shingles(own), shingles(edited), shingles(following)
        j = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        assert (x["near_edited"], x["near_next"]) == (pytest.approx(j(a, b)), pytest.approx(j(a, c)))
        assert x["n_shingles"] == len(a) and x["both_shingles"] == len(a | b)
        assert x["kept_part"] == pytest.approx(len(a & b) / len(a) if a else 1.0)
