"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of a language's most frequent letter n-grams. A text is given the language whose profile
its own most frequent n-grams match best by the out-of-place distance: the sum of how far each n-gram's rank
is from its rank in the profile, with a fixed penalty for one that is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.texts import by_text, crc_mod

#: n-grams in a profile and of a text; lengths of n-grams.
PROFILE, TOP, SIZES = 400, 300, (1, 2, 3)
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in each process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a lower-cased text, codes ascending.

    Runs of other characters count as one blank; an n-gram's code holds its code points, 21 bits each.
    n-grams that are all blank, or hold a blank inside, are left out.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = _letters()[raw]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(is_letter, raw, 32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    c = np.pad(c, (int(c[0] != 32), int(c[-1] != 32)), constant_values=32)
    one = c[c != 32]
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 32]
    codes, counts = np.unique(np.concatenate([one, two, three]), return_counts=True)
    return codes, counts


def top_grams(codes: np.ndarray, counts: np.ndarray, n: int = TOP) -> np.ndarray:
    """Codes of the n most frequent, most frequent first; ties by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


def profiles(rows: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The `size` most frequent n-grams of each lang, from rows (_text, lang); null langs are passed over.

    Counts run over all rows: each partition adds up its own before anything is shuffled. A language's
    vocabulary of n-grams, not its texts, is ranked; `size` codes a language reach the driver.
    """

    def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        return codes, np.bincount(place, weights=np.concatenate([f[1] for f in found]), minlength=len(codes)).astype(np.int64)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, int] = {}
        for b in batches:
            for lang, t in zip(b["lang"], b["_text"], strict=True):
                one = grams(t)
                held.setdefault(lang, []).append(one)
                waiting[lang] = waiting.get(lang, 0) + len(one[0])
                if waiting[lang] > 1_000_000:  # bounds memory: the vocabulary and so many codes
                    held[lang], waiting[lang] = [added(held[lang])], 0
        for lang, found in held.items():
            codes, counts = added(found)
            yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    counted = rows.where("lang is not null").mapInPandas(of, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the best of each of 64 slices first, so that no task ranks a whole vocabulary
    order = (F.col("n").desc(), F.col("code"))
    sliced = counted.withColumn("slice", F.pmod(F.xxhash64("code"), F.lit(64)))
    best = sliced.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("r") <= size)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    out: dict[str, list] = {}
    for r in best.select("lang", "r", "code").collect():
        out.setdefault(r["lang"], []).append((r["r"], r["code"]))
    return {lang: np.array([c for _, c in sorted(v)], np.int64) for lang, v in sorted(out.items())}


class Ranker:
    """Out-of-place distances of a text to every profile at once."""

    def __init__(self, found: dict[str, np.ndarray]) -> None:
        self.langs = list(found)
        self.codes = np.unique(np.concatenate([*found.values(), np.empty(0, np.int64)])) if found else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for k, codes in enumerate(found.values()):
            self.ranks[k, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def best(self, text: str | None) -> tuple[str, float]:
        """(language, score); score: how much nearer the best profile is than the next, 0 to 1."""
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = top_grams(codes, counts)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        rank = self.ranks[:, at]
        far = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(far, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1 - int(far[0]) / (PROFILE * len(top))
        first, second = int(far[order[0]]), int(far[order[1]])
        return self.langs[order[0]], (second - first) / second if second else 0.0


def identify(docs: DataFrame, held_out: int = 0, folds: int = 5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learned from the texts and non-null languages of rows whose crc32 of the id, mod folds, is not held_out
    (rows with a null id are learned from). Texts that are null or hold no letter are 'und', as is everything
    if nothing could be learned. Ties go to the language first in code-point order. Repeated rows are
    counted and labelled one by one; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("lang"))
    held = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    found = profiles(rows.where(~held).select("_text", "lang"))
    kept: list[Ranker] = []  # one in each task's process

    def of(texts: list) -> tuple[dict[str, pa.Array], None]:
        if not kept:
            kept.append(Ranker(found))
        named = [kept[0].best(t) for t in texts]
        return {"lang_pred": pa.array([x[0] for x in named], pa.string()), "score": pa.array([x[1] for x in named], pa.float64())}, None

    return by_text(rows, of, "lang_pred string, score double", text="_text", carried={"held_out": held})
