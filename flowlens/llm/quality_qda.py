"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of each whole text are transformed to be near normal. Per class, their mean and covariance come
from sums over all labelled training rows; covariances are shrunk towards the pooled one and towards a
multiple of the identity. A score is the logistic of the Mahalanobis log-density difference, computed with
cached Cholesky factors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.quality_rules import consistent_labels
from flowlens.llm.texts import by_text, crc_mod
from flowlens.plans.shared import cut

FEATURES = ("chars", "words", "word_len", "long_word", "variety", "repeats", "dup_lines", "line_words", "upper", "digits", "symbols", "bangs", "stops", "other", "wide", "entropy")
#: Parts of the pooled covariance and of the identity in each class covariance, and the score's softening.
POOLED, ROUND, HEAT = 0.1, 0.02, 4.0
#: Statistics are multiples of 1 / GRAIN.
GRAIN = 4096

_CLASS = np.zeros((256, 8))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", bytes(set(range(33, 127)) - set(b"#*$%&|<>!?.,;:") - set(b"0123456789") - {c for c in range(65, 91)} - {c for c in range(97, 123)}), bytes(range(128, 256)), b" \t\n\x0b\f\r")):
    _CLASS[list(_chars), _i] = 1


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one text; those of an empty text are all defined."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, w = max(len(data), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, symbols, bangs, stops, other, wide, blank = counts @ _CLASS
    ink = max(len(data) - blank, 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    p = counts[counts > 0] / n
    share = lambda x: math.log((x + 0.002) / (1 - min(x, 0.999) + 0.002))
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(ink / w), math.log1p(max(map(len, words), default=0)), len(set(words)) / math.sqrt(w) / 10,
        share(1 - len(set(windows)) / max(len(windows), 1) if windows else 0.0), share(1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0), math.log1p(len(words) / max(len(lines), 1)),
        share(upper / ink), share(digits / ink), share(symbols / ink), share(bangs / ink), share(stops / ink), share(other / ink), share(wide / ink), float(-(p * np.log(p)).sum()),
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row: one narrow pass. Statistics are rounded to 1 / GRAIN, so that sums can be whole numbers."""

    def of(texts: list) -> tuple[dict[str, pa.Array], None]:
        x = np.rint(np.array([statistics(t) for t in texts]).reshape(-1) * GRAIN) / GRAIN
        ends = np.arange(0, len(x) + 1, len(FEATURES), dtype=np.int32)
        return {"x": pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.float64()))}, None

    return by_text(docs, of, "x array<double>", doc_id, text)


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, log determinant."""

    parts: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]
    heat: float = HEAT

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for prior, mean, factor, det in self.parts:
            z = (x - mean) @ factor.T
            logs.append(prior - 0.5 * ((z * z).sum(axis=1) + det))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / self.heat, -500, 500)))


def fit(rows: DataFrame, dims: int = len(FEATURES), pooled: float = POOLED, round_: float = ROUND) -> Discriminant | None:
    """Discriminant from (x array<double>, quality 0 or 1); None unless both classes have two rows.

    One aggregation with map-side combining, of whole numbers: the sums are the same in any order. Two rows of
    sums reach the driver.
    """
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    whole = F.transform("x", lambda v: F.rint(v * GRAIN).cast("long"))
    sums = [F.sum(F.col("w")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)] + [F.sum((F.col("w")[i] * F.col("w")[j]).cast("decimal(38,0)")).alias(f"s{i}_{j}") for i, j in pairs]
    found = {r["quality"]: r for r in rows.where("quality in (0, 1)").select("quality", whole.alias("w")).groupBy("quality").agg(F.count("*").alias("n"), *sums).collect()}
    if any(k not in found or found[k]["n"] < 2 for k in (0, 1)):
        return None
    n, means, spread = {}, {}, {}
    for k in (0, 1):
        r = found[k]
        n[k], means[k] = r["n"], np.array([float(r[f"s{i}"]) for i in range(dims)]) / GRAIN / r["n"]
        s = np.zeros((dims, dims))
        for i, j in pairs:
            s[i, j] = s[j, i] = float(r[f"s{i}_{j}"]) / GRAIN**2 / r["n"] - means[k][i] * means[k][j]
        spread[k] = s
    both = (n[0] * spread[0] + n[1] * spread[1]) / (n[0] + n[1])
    parts = []
    for k in (0, 1):
        s = (1 - pooled) * spread[k] + pooled * both
        s = (1 - round_) * s + round_ * max(np.trace(s) / dims, 1e-6) * np.eye(dims)
        factor = np.linalg.cholesky(s)
        parts.append((math.log(n[k] / (n[0] + n[1])), means[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Discriminant(tuple(parts))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, folds: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Rows whose crc32 of the id, mod folds, is held_out are never learned from; neither are rows with a null id
    or contradicting labels. Null text counts as empty. Without two labelled rows of each class every score is
    0.5. Repeated rows are scored (and, if labelled, learned from) one by one; other columns are not read.
    """
    x = cut(document_statistics(docs), "statistics")
    held = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    model = fit(x.where(~held).join(consistent_labels(labels), "doc_id"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = model.scores(x) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(x.dtypes)["doc_id"]
    return x.select("doc_id", held.alias("held_out"), "x").mapInArrow(of, f"doc_id {kind}, held_out boolean, score double, predicted int")
