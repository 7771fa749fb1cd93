"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank: the weight of features i and j is <v_i, v_j>.  Scoring uses
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum x_i v_i|^2 - sum |x_i v_i|^2) / 2``, so it is linear in the
number of features present.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, labelled_texts, release
from .textscan import Scan, chunks, encode

WORDS, BINS, RANK = 1 << 13, 8, 8
RUN = 64  # labelled texts that are looked at together
_MARKS = [ord(c) for c in "#*$%&|<>!?.,:;{}()[]=_-/@~^\"'"]
_STATS = 14 + len(_MARKS)
FEATURES = WORDS + _STATS * BINS


def statistics(scan: Scan) -> np.ndarray:
    """Structure statistics of each text, each scaled to 0..1; length is the only metadata."""
    edges = np.r_[0, scan.text_end]
    hist = np.stack([np.bincount(scan.bytes[a:b], minlength=256) for a, b in zip(edges, edges[1:], strict=False)]).astype(float)
    hist[:, 10] -= 1  # the newline between texts
    n, k = np.maximum(hist.sum(axis=1), 1), np.maximum(scan.count, 1)
    by = lambda doc, w=None: np.bincount(doc, w, minlength=scan.n)
    doc, line, *_ = scan.lines()
    lines = by(doc)
    distinct = by(np.unique(np.stack([doc.astype(np.uint64), line]), axis=1)[0].astype(np.int64)) if len(doc) else lines
    pair = np.flatnonzero((scan.hash[1:] == scan.hash[:-1]) & (scan.doc[1:] == scan.doc[:-1]))
    order = np.lexsort((scan.hash, scan.doc))
    d, h = scan.doc[order], scan.hash[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])][: len(d)])
    top = np.zeros(scan.n)
    np.maximum.at(top, d[new], np.diff(np.r_[new, len(d)]))
    size = (scan.end - scan.start).astype(float)
    mean = by(scan.doc, size) / k
    upper, lower = hist[:, 65:91].sum(axis=1), hist[:, 97:123].sum(axis=1)
    marks = hist[:, 33:48].sum(axis=1) + hist[:, 58:65].sum(axis=1) + hist[:, 91:97].sum(axis=1) + hist[:, 123:127].sum(axis=1)
    columns = [
        np.log1p(scan.count) / 12,
        np.log1p(lines) / 8,
        by(d[new]) / k,
        by(scan.doc[pair]) / k,
        1 - distinct / np.maximum(lines, 1),
        upper / np.maximum(upper + lower, 1),
        hist[:, 48:58].sum(axis=1) / n,
        hist[:, 128:].sum(axis=1) / n,
        hist[:, 32] / n * 3,
        marks / n,
        mean / 20,
        np.sqrt(np.maximum(by(scan.doc, size * size) / k - mean * mean, 0)) / 20,
        by(scan.doc[size == 1]) / k,
        top / k,
    ]
    return np.clip(np.c_[np.stack(columns, axis=1), 5 * hist[:, _MARKS] / k[:, None]], 0, 1)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, at, x)``: feature numbers and values of each text behind one another, and where each text's begin.

    Hashed words weigh by root frequency (their vector has length one); each statistic lies in a
    soft bin.  A null text counts as an empty one.
    """
    scan = Scan(encode(texts))
    key, count = np.unique(scan.doc * WORDS + (scan.hash % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    doc, at, x = key // WORDS, key % WORDS, np.sqrt(count)
    x = x / np.sqrt(np.maximum(np.bincount(doc, count, minlength=scan.n), 1))[doc]
    s = statistics(scan) ** 0.5 * (BINS - 1)
    low = np.minimum(s.astype(np.int64), BINS - 2)
    base = WORDS + np.arange(_STATS) * BINS + low
    part = s - low
    owner = np.repeat(np.arange(scan.n), _STATS)
    owner, at = np.r_[doc, owner, owner], np.r_[at, base.ravel(), base.ravel() + 1]
    x = np.r_[x, (1 - part).ravel() / 3, part.ravel() / 3]
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(scan.n)), at[order], x[order]


@dataclass
class QualityModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # FEATURES x RANK

    def scores(self, texts: list[str | None]) -> np.ndarray:
        first, at, x = features(texts)
        xv = x[:, None] * self.factors[at]
        total = np.add.reduceat(xv, first)
        pairs = 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((xv * xv).sum(axis=1), first))
        margin = self.bias + np.add.reduceat(x * self.linear[at], first) + pairs
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def train(sample: list[tuple[str, int]], epochs: int = 12, rate: float = 0.15, decay: float = 2e-4, seed: int = 3) -> QualityModel:
    """Logistic loss with adaptive gradient steps; classes weigh alike.  One class only: its label is always predicted."""
    rng = np.random.default_rng(seed)
    model = QualityModel(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, RANK)))
    labels = {y for _, y in sample}
    if len(labels) < 2:
        model.factors[:] = 0
        model.bias = 6.0 if labels != {0} else -6.0
        return model
    rows = []
    for part in (sample[k : k + RUN] for k in range(0, len(sample), RUN)):  # a text's features don't depend on others
        first, every, values = features([t for t, _ in part])
        rows += [(every[a:b], values[a:b], y) for a, b, (_, y) in zip(first, [*first[1:], len(every)], part, strict=True)]
    pos = sum(y for _, _, y in rows)
    weight = (len(rows) / (2 * (len(rows) - pos)), len(rows) / (2 * pos))
    g0, gl, gf = 1e-6, np.full(FEATURES, 1e-4), np.full((FEATURES, RANK), 1e-4)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            v = model.factors[at]
            xv = x[:, None] * v
            total = xv.sum(axis=0)
            m = model.bias + x @ model.linear[at] + 0.5 * (total @ total - (xv * xv).sum())
            g = weight[y] * (1 / (1 + np.exp(-np.clip(m, -50, 50))) - y)
            step_l = g * x + decay * model.linear[at]
            step_f = g * x[:, None] * (total - xv) + decay * v
            g0 += g * g
            model.bias -= rate * g / g0**0.5
            np.add.at(gl, at, step_l**2)
            np.add.at(model.linear, at, -rate * step_l / np.sqrt(gl[at]))
            np.add.at(gf, at, step_f**2)
            np.add.at(model.factors, at, -rate / 3 * step_f / np.sqrt(gf[at]))
    return model


def scorer(model: QualityModel):
    """An Arrow UDF from text to its quality score."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.scores(texts) for texts in chunks(batch)]
            yield pa.array(np.concatenate(parts) if parts else [], type=pa.float64())
        release()

    return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, max_chars: int = 20_000) -> QualityModel:
    """Trains on at most about ``rows`` labelled texts of at most ``max_chars`` characters (see labelled_texts)."""
    return fitted(labelled_texts(docs, labels, "quality", 5, 0, rows, max_chars), train)


def with_quality(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` with each whole text's quality, 0 to 1, in ``column``; a null text scores as an empty one.

    Repeated rows score alike, and ids decide nothing.  A column of that name is replaced, all others stay; no rows give no rows.
    """
    return docs.withColumn(column, scorer(model)(F.col("text")))
