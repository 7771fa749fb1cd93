"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Rolling 64-bit hashes of words, lines and n-grams of several lengths are taken for many texts at
once in numpy; a length costs one pass and one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .textscan import Scan, chunks, encode

#: Largest share of word characters inside repeated n-grams, by length; and of repeated lines (by number, by characters).
GRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_LIMIT, LINE_CHAR_LIMIT = 0.40, 0.30
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

STATS = pa.struct(
    [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("line_share", pa.float64()), ("line_char_share", pa.float64())]
    + [(f"gram{n}_share", pa.float64()) for n in GRAM_LIMITS]
)
STATS_TYPE = from_arrow_type(STATS)


def repeated(scan: Scan, n: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more in their text; the first occurrence counts."""
    at, h = scan.windows(n)
    h = h ^ (scan.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    edge = np.zeros(len(scan.hash) + 1, dtype=np.int32)
    if same.any():
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge += np.bincount(at[twice], minlength=len(edge)).astype(np.int32)
        edge -= np.bincount(at[twice] + n, minlength=len(edge)).astype(np.int32)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All statistics and the verdict of each text; null is a text without words."""
    scan = Scan(encode(texts))

    def by_text(doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(doc, weights, minlength=scan.n)
        return out if weights is None else np.rint(out).astype(np.int64)

    chars = scan.codepoints(scan.start, scan.end)
    total = by_text(scan.doc, chars)
    marks = np.flatnonzero(_SYMBOL[scan.bytes])
    doc, line, _, a, b = scan.lines()
    before = np.r_[0, np.cumsum(chars)]
    order = np.lexsort((np.arange(len(line)), line, doc))
    again = np.zeros(len(line), dtype=bool)
    again[order[1:]] = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = {"n_words": scan.count, "word_chars": total, "n_symbols": by_text(np.searchsorted(scan.text_end, marks, side="right"))}
    out["n_dup_lines"] = by_text(doc[again])
    some, all_words = np.maximum(total, 1), np.maximum(scan.count, 1)
    shares = {"line_share": out["n_dup_lines"] / np.maximum(by_text(doc), 1), "line_char_share": by_text(doc[again], (before[b] - before[a])[again]) / some}
    good = (shares["line_share"] <= LINE_LIMIT) & (shares["line_char_share"] <= LINE_CHAR_LIMIT)
    for n, limit in GRAM_LIMITS.items():
        inside = repeated(scan, n)
        if n == 5:
            out["n_repeat_words"] = by_text(scan.doc[inside])
        shares[f"gram{n}_share"] = by_text(scan.doc, chars * inside) / some
        good &= shares[f"gram{n}_share"] <= limit
    out["base_failed"] = (scan.count < 10) | (100 * out["n_repeat_words"] > 20 * all_words)
    out["kept"] = good & ~out["base_failed"]
    return out | shares


@F.arrow_udf(STATS_TYPE)
def repetition(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The statistics of each text, as a struct."""
    for batch in batches:
        parts = [measure(texts) for texts in chunks(batch)]
        columns = [pa.array(np.concatenate([p[f.name] for p in parts]) if parts else [], type=f.type) for f in STATS]
        yield pa.StructArray.from_arrays(columns, fields=list(STATS))


def with_repetition(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``repetition`` of each whole text's statistics and verdict (``kept``).

    Null and empty texts have no words and are not kept.  Ties and repeated rows are judged alike, and ids decide nothing.
    A column named repetition is replaced, all others stay; no rows give no rows.
    """
    return docs.withColumn("repetition", repetition(F.col("text")))
