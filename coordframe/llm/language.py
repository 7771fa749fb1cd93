"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained with follow-the-regularised-leader (per-coordinate steps, elastic-net
penalties), which leaves most of them exactly zero; a temperature fitted on texts kept back from
training calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_sample, fitted, fold

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the text's character n-grams, lower-case, white space as one space."""
    low = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    parts = []
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15))
            parts.append((x * np.uint32(0x2C1B3C6D)) >> np.uint32(17))
    found = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    at = np.flatnonzero(found)
    return at, found[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # BUCKETS
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(1e-9, float(np.sqrt(x @ x)))

    def logits(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ``und`` with 0 for texts without a letter."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(
    sample: list[tuple[str, str]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 5
) -> LanguageModel:
    """FTRL-proximal on ``(text, language)``; a fifth of the sample is kept back for the temperature."""
    sample = [(t, lang) for t, lang in sample if t and has_letter(t)]
    languages = sorted({lang for _, lang in sample})
    k = len(languages)
    model = LanguageModel(languages, np.ones(BUCKETS), np.zeros((BUCKETS, k)), np.zeros(k))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    kept, used = order[: len(sample) // 5], order[len(sample) // 5 :]
    df = np.zeros(BUCKETS)
    for i in used:
        df[counts(sample[i][0])[0]] += 1
    model.idf = np.log((1 + len(used)) / (1 + df)) + 1
    rows = [(*model.features(sample[i][0]), languages.index(sample[i][1])) for i in used]
    # a bias is one more coordinate, without penalties
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    pen1, pen2 = np.full((BUCKETS + 1, 1), l1), np.full((BUCKETS + 1, 1), l2)
    pen1[-1] = pen2[-1] = 0

    def leader(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= pen1[at], 0.0, (np.sign(zz) * pen1[at] - zz) / ((beta + np.sqrt(nn)) / alpha + pen2[at]))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.r_[at, BUCKETS], np.r_[x, 0.3]
            w = leader(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sq = n[at] + g * g
            z[at] += g - (np.sqrt(sq) - np.sqrt(n[at])) / alpha * w
            n[at] = sq
    w = leader(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:-1], 0.3 * w[-1]
    if len(kept):
        logits = np.array([model.logits(sample[i][0]) for i in kept])
        truth = np.array([languages.index(sample[i][1]) for i in kept])

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def fit(docs: DataFrame, rows: int = 4000, max_chars: int = 20_000) -> LanguageModel:
    """Trains on at most about ``rows`` texts, equal by language, outside fold 2 of 4.

    Only texts of at most ``max_chars`` characters are learned from.  The languages must be few
    enough to be counted on the driver.
    """
    known = docs.select("doc_id", "text", F.col("lang").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), 4) != 2) & (F.length("text") <= max_chars)
    )
    got = class_sample(known, rows, 13).groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x"))  # an id once
    return fitted(got.select("doc_id", "x.text", "x.label"), train)


def predictor(model: LanguageModel):
    """An Arrow UDF from text to a struct of language and probability."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 256):
                out += [model.predict(t) for t in batch.slice(at, 256).to_pylist()]
            yield pa.array([{"lang_pred": a, "score": b} for a, b in out], type=kind)

    return predict


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with a struct column ``language`` (lang_pred, score) of each whole text.

    Null texts and texts without a letter are ``und`` with score 0.  Repeated rows are judged alike, and ids decide nothing.
    A column named language is replaced, all others stay; no rows give no rows.
    """
    return docs.withColumn("language", predictor(model)(F.col("text")))
