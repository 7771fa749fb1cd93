"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystrom landmarks.

The kernel of two strings sums, over all character triples, the products of their decayed
occurrence weights: a triple spread over ``s`` characters weighs ``DECAY**s``, spreads beyond
``SPAN`` weigh nothing.  So ``mo-ron`` or ``idxiot`` still share most triples with the plain word.
A text is seen through its strings: words, runs of single characters joined into one, and phrases,
which are the windows of two to PHRASE neighbouring words with a mark between them, so that gaps may
cross a word boundary.  A text's margin is that of its most suspicious string.

Training is multiple-instance: strings of clean documents are negative, and each toxic document
is represented by its witness, the string with the highest margin, chosen again in every round.  Since the Nystrom features are linear in the triples of the string, the trained
model folds into one weight for each triple and scoring costs a table lookup per triple.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, labelled_texts, release
from .textscan import chunks

DECAY, SPAN, MAX_STRING, CACHE = 0.7, 6, 32, 150_000
PHRASE, RUN, MARK = 3, 8192, "\x01"
PIECE, DENSE, MARK_BITS = 1 << 18, 1 << 21, 21
_OFFSETS = [(p, q) for q in range(2, SPAN) for p in range(1, q)]
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_CUT = re.compile(r"(?<=\s)\S\S")
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def strings_of(text: str) -> set[str]:
    """The distinct strings of a text: stripped lower-case words, and joined runs of single characters.

    Words over MAX_STRING characters are cut into overlapping windows, so whole texts are covered.
    """
    low = text.lower()
    out = set(low.split())
    if any(len(w) == 1 for w in out):
        out.update(re.sub(r"\s", "", m) for m in _SPACED.findall(low))
    out = {w.strip(_EDGES) for w in out}
    for w in [w for w in out if len(w) > MAX_STRING]:
        out.discard(w)
        out.update(w[i : i + MAX_STRING] for i in range(0, len(w) - MAX_STRING // 2, MAX_STRING // 2))
    out.discard("")
    return out


def words_of(text: str) -> list[str]:
    """The stripped lower-case words of a text in order; one over MAX_STRING characters in pieces."""
    out = []
    for w in text.replace(MARK, " ").lower().split():
        w = w.strip(_EDGES)
        if len(w) <= MAX_STRING:
            if w:
                out.append(w)
        else:
            out += [w[i : i + MAX_STRING] for i in range(0, len(w), MAX_STRING)]
    return out


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of at least PIECE characters, each cut before a word of several characters, so in no run of single ones."""
    at = 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all strings, each between two marks and with SPAN zeros behind it, and their string's number."""
    joined = "".join(MARK + s + MARK + "\0" * SPAN for s in strings)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(strings)), [len(s) + 2 + SPAN for s in strings])
    return chars, owner


def _triples(chars: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: the three characters, the string's number and the weight."""
    n = len(chars) - SPAN
    for p, q in _OFFSETS:
        a, b, c = chars[:n], chars[p : n + p], chars[q : n + q]
        ok = (a > 0) & (b > 0) & (c > 0)
        ok &= owner[:n] == owner[q : n + q]
        yield a[ok], b[ok], c[ok], owner[:n][ok], DECAY ** (q + 1)


def _norms(chars: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The square root of each string's kernel with itself."""
    keys, weights, owners = [], [], []
    for a, b, c, o, w in _triples(chars, owner):
        keys.append(((a * 2097152 + b) * 2097152 + c) ^ (o * 0x9E3779B97F4A7C1))
        weights.append(np.full(len(a), w))
        owners.append(o)
    if not keys:
        return np.zeros(n)
    key, weight, own = np.concatenate(keys), np.concatenate(weights), np.concatenate(owners)
    order = np.lexsort((key, own))
    key, weight, own = key[order], weight[order], own[order]
    if not len(key):
        return np.zeros(n)
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    return np.sqrt(np.bincount(own[new], np.add.reduceat(weight, new) ** 2, minlength=n))


def feature_map(s: str) -> dict[tuple[int, int, int], float]:
    """The explicit triple weights of one string, scaled to length one."""
    out: dict[tuple[int, int, int], float] = defaultdict(float)
    for a, b, c, _, w in _triples(*_codes([s])):
        for t in zip(a.tolist(), b.tolist(), c.tolist(), strict=True):
            out[t] += w
    norm = sum(v * v for v in out.values()) ** 0.5
    return {t: v / norm for t, v in out.items()} if norm else {}


def kernel(s: str, t: str) -> float:
    """The normalised kernel of two strings, 0 to 1."""
    a, b = feature_map(s), feature_map(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


class _Sparse:
    """What an array that is ``rest`` but at a few places gives for places, in memory of those few."""

    def __init__(self, places: np.ndarray, values: np.ndarray, rest: float):
        order = np.argsort(places)
        self.places, self.values, self.rest = places[order], values[order], values.dtype.type(rest)
        self.marks = np.zeros(1 << MARK_BITS, dtype=bool)  # most other places end here
        self.marks[self._mark(self.places)] = True

    @staticmethod
    def _mark(at: np.ndarray) -> np.ndarray:
        return ((at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), self.rest)
        some = np.flatnonzero(self.marks[self._mark(at)])
        place = at[some]
        k = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
        out[some] = np.where(self.places[k] == place, self.values[k], self.rest)
        return out


def _by_place(size: int, places: np.ndarray, values: np.ndarray, rest: float) -> np.ndarray | _Sparse:
    """``values`` at their places among size ** 3 triples and ``rest`` elsewhere; an array only of a small alphabet's."""
    if size**3 > DENSE:
        return _Sparse(places, values, rest)
    out = np.full(size**3, rest, dtype=values.dtype)
    out[places] = values
    return out


def _numbers(alphabet: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Each character's place in the alphabet from 1 on, or 0, wide enough for the place of a triple."""
    at = np.searchsorted(alphabet, chars)
    at[at == len(alphabet)] = 0
    return np.where(alphabet[at] == chars, at + 1, 0).astype(np.int32 if (len(alphabet) + 1) ** 3 < 1 << 31 else np.int64)


@dataclass
class ToxicityModel:
    """One weight for each triple of landmark characters, an intercept, and the sigmoid's slope."""

    alphabet: np.ndarray  # sorted code points that occur in landmarks
    table: np.ndarray | _Sparse  # weights of (A + 1) ** 3 triples; index 0 stands for every other character
    bias: float
    slope: float

    def margins(self, strings: list[str]) -> np.ndarray:
        """max(0, <w, x> / |x|) for each string; a string that no landmark speaks against costs no norm."""
        if not strings or not len(self.alphabet):
            return np.zeros(len(strings))
        chars, owner = _codes(strings)
        code = _numbers(self.alphabet, chars)
        size, n = len(self.alphabet) + 1, len(chars) - SPAN
        total = np.zeros(n, dtype=np.float32)
        lead = code[:n] * (size * size)
        for p, q in _OFFSETS:  # a string's zeros keep its triples apart from the next one's
            total += np.float32(DECAY ** (q + 1)) * self.table[lead + code[p : n + p] * size + code[q : n + q]]
        raw = np.bincount(owner[:n], total, minlength=len(strings))
        out = np.zeros(len(strings))
        hot = np.flatnonzero(raw > 0)
        if len(hot):
            some = [strings[i] for i in hot.tolist()]
            out[hot] = raw[hot] / np.maximum(_norms(*_codes(some), len(some)), 1e-12)
        return out

    def phrases(self, texts: Iterable[list[str]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of words, all their phrases: the joined words, and each phrase's text, first and last mark, and a bound of its margin.

        A phrase's sum is a difference of running sums.  Its norm is at least that of triples which all differ,
        so no margin exceeds its bound.  Runs overlap by the words of a phrase but one.
        """
        if not len(self.alphabet):
            return
        runs, n = [], 0
        for k, words in enumerate(texts):
            for i in range(0, max(1, len(words) - PHRASE + 1), RUN):
                runs.append((k, words[i : i + RUN + PHRASE - 1]))
                n += len(runs[-1][1])
                if n >= RUN:
                    yield self._bounds(runs)
                    runs, n = [], 0
        if n:
            yield self._bounds(runs)

    def _bounds(self, runs: list[tuple[int, list[str]]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined = "".join(MARK + MARK.join(words) + MARK + "\0" * SPAN for _, words in runs)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        code = _numbers(self.alphabet, chars)
        size, n = len(self.alphabet) + 1, len(chars) - SPAN
        lead, upto = code[:n] * (size * size), {}
        for q in range(2, SPAN):
            total = np.zeros(n, dtype=np.float32)
            for p in range(1, q):
                total += self.table[lead + code[p : n + p] * size + code[q : n + q]]
            upto[q] = np.r_[0.0, np.cumsum(total * DECAY ** (q + 1), dtype=np.float64)]
        marks = np.flatnonzero(chars == ord(MARK))
        run = np.repeat(np.arange(len(runs)), [len(words) + 1 if words else 2 for _, words in runs])
        starts, ends, owner = [], [], []
        for k in range(2, PHRASE + 1):
            ok = np.flatnonzero(run[k:] == run[:-k])
            starts.append(marks[ok])
            ends.append(marks[ok + k])
            owner.append(run[ok])
        start, end = np.concatenate(starts), np.concatenate(ends)
        raw, least = np.zeros(len(start)), np.zeros(len(start))
        for q, sums in upto.items():
            raw += sums[end - q + 1] - sums[start]
            least += (q - 1) * (end - start + 1 - q) * DECAY ** (2 * (q + 1))
        text = np.array([k for k, _ in runs], dtype=np.int64)[np.concatenate(owner)]
        return joined, text, start, end, np.maximum(raw, 0) / np.sqrt(least) * (1 + 1e-5)

    def with_phrases(self, texts: Iterable[list[str]], floor: np.ndarray) -> tuple[np.ndarray, dict[int, str]]:
        """Each text's highest margin, ``floor`` (that of its words) or a phrase's, and the phrases that exceed the floor.

        Only phrases whose bound exceeds what their text has are computed: its top one, then what is left.
        """
        best, which = np.array(floor, dtype=np.float64), {}
        for joined, text, start, end, bound in self.phrases(texts):
            for top in (True, False):
                at = np.flatnonzero(bound > best[text])
                if top:
                    at = at[np.lexsort((-bound[at], text[at]))]
                    at = at[np.r_[True, text[at][1:] != text[at][:-1]]] if len(at) else at
                names = [joined[a + 1 : b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                for k, name, m in zip(text[at].tolist(), names, self.margins(names).tolist(), strict=True):
                    if m > best[k]:
                        best[k], which[k] = m, name
                bound[at] = 0
        return best, which

    def worst_phrases(self, texts: Iterable[list[str]], level: float, most: int) -> dict[str, float]:
        """About the ``most`` phrases of highest margin over ``level``."""
        found: dict[str, float] = {}
        for joined, _, start, end, bound in self.phrases(texts):
            at = np.flatnonzero(bound > level)
            at = at[np.argsort(-bound[at], kind="stable")][:most]
            found.update((joined[a + 1 : b], x) for a, b, x in zip(start[at].tolist(), end[at].tolist(), bound[at].tolist(), strict=True))
            if len(found) > 8 * most:
                found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])
        names = sorted(found, key=lambda w: (-found[w], w))[:most]
        return {w: m for w, m in zip(names, self.margins(names).tolist(), strict=True) if m > level}

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (margin + self.bias), -60, 60)))


def _svm(x: np.ndarray, y: np.ndarray, c: float, rounds: int) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, class-balanced) by accelerated gradient descent."""
    pos = max(1, int((y > 0).sum()))
    cost = (np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * max(1, len(y) - pos))) * c / len(y)).astype(x.dtype)
    xb = np.c_[x, np.ones(len(x), dtype=x.dtype)]
    top = np.ones(xb.shape[1], dtype=x.dtype)  # the largest curvature, by power iteration, and some room above it
    for _ in range(30):
        top /= np.linalg.norm(top)
        top = xb.T @ (cost * (xb @ top))
    step = 1.0 / (1.0 + 2.2 * float(np.linalg.norm(top)))
    w = v = np.zeros(xb.shape[1], dtype=x.dtype)
    y = y.astype(x.dtype)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (xb @ v))
        g = np.r_[v[:-1], x.dtype.type(0)] - 2 * xb.T @ (cost * y * slack)
        new, t2 = v - x.dtype.type(step) * g, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + x.dtype.type((t - 1) / t2) * (new - w), new, t2
    return w[:-1], float(w[-1])


def _noisy(s: str, rng: np.random.Generator) -> list[str]:
    """The string with a character inserted, with a mark inserted, and with one repeated."""
    i = int(rng.integers(1, max(2, len(s))))
    return [s[:i] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + s[i:], s[:i] + ".-*_"[int(rng.integers(4))] + s[i:], s[:i] + s[i - 1] + s[i:]]


def train(sample: list[tuple[str, int]], landmarks: int = 160, rounds: int = 4, seed: int = 11) -> ToxicityModel:
    """Fits the model on labelled texts.  Without both classes it scores every text 0."""
    if len({y for _, y in sample}) < 2:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(1, np.float32), -10.0, 6.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}  # each word is held once, and texts are numbers of words

    def numbers(words: list[str]) -> np.ndarray:
        return np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int32)

    everything = _without_copies([(sorted(map(sys.intern, strings_of(t))), y, numbers([sys.intern(w) for w in words_of(t)])) for t, y in sample])
    names = list(vocabulary)

    def spelled(text: np.ndarray) -> list[str]:
        return [names[i] for i in text.tolist()]

    back = rng.permutation(len(everything))[: len(everything) // 5]  # kept back for the sigmoid
    hidden = set(back.tolist())
    bags = [b for i, b in enumerate(everything) if i not in hidden]
    n_pos = sum(y for _, y, _ in bags)
    seen = {y: Counter(w for b, z, _ in bags if z == y for w in b) for y in (0, 1)}
    scale = n_pos / max(1, len(bags) - n_pos)
    excess = {}  # standard deviations above the count that clean documents let expect
    for w, k in seen[1].items():
        if k > 1 and len(w) > 1:
            expected = (seen[0][w] + 0.5) * scale
            excess[w] = (k - expected) / (expected + 1) ** 0.5
    bar = 3.0 + 0.5 * np.log10(1 + len(excess))
    doubtful = {w for w in excess if excess[w] > bar and seen[1][w] > 6 * seen[0][w] * scale}
    phrases = _Phrases([(words, y) for _, y, words in bags], vocabulary)
    in_text, clean_texts = phrases.doubtful(scale, doubtful)
    clean_texts.update((w, seen[0][w]) for w in doubtful)
    excess.clear()
    suspects: list[str] = []  # greedy cover: each next string explains the most toxic texts still unexplained
    left = [(set(b) & doubtful | in_text.get(k, set()), [1.0]) for k, (b, y, _) in enumerate(bags) if y]  # an explained text counts 0.3
    while len(suspects) < landmarks * 3 // 4:
        cover: Counter[str] = Counter()
        for words, weight in left:
            for w in words:
                cover[w] += weight[0]
        for w in suspects:
            cover.pop(w, None)
        best = min(cover, key=lambda w: (-cover[w] / (1 + 20 * clean_texts[w]), w), default=None)
        if best is None or cover[best] < 1.5:
            break
        suspects.append(best)
        for words, weight in left:
            if best in words:
                weight[0] = 0.3
    if not suspects:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(1, np.float32), -10.0, 6.0)
    clean = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))]
    rare = clean[2500:]
    rng.shuffle(rare)
    negatives = clean[:2500] + rare[:2500]
    negatives += [x for s in negatives[:300] for x in _noisy(s, rng)[:2]]
    negatives += phrases.sample(0, 2500, rng)
    marks, witness = suspects + [w for w in clean if len(w) > 1][: landmarks - len(suspects)], set(suspects)
    for k in range(rounds):
        if k:
            score = _lookup(model, {w for b, _, _ in bags for w in b})
            toxic = [(max(b, key=lambda w: (score[w], w)), words) for b, y, words in bags if y and b]
            margins, which = model.with_phrases((spelled(words) for _, words in toxic), np.array([score[w] for w, _ in toxic]))
            witness = {which.get(i, w) for i, (w, _) in enumerate(toxic) if margins[i] + model.bias > -0.5}
            witness = {w for w in witness if w not in seen[0] and not (MARK in w and phrases.clean(w))}
            hard = sorted((w for w in seen[0] if score[w] + model.bias > -0.8), key=lambda w: (-score[w], w))
            marks = marks + [w for w in hard if w not in set(marks)][: landmarks // 2]
            close = {w: m for w, m in model.worst_phrases((spelled(words) for _, y, words in bags if not y), -0.8 - model.bias, 800).items() if w not in set(suspects)}
            score.update(close)
            marks = marks + [w for w in close if w not in set(marks)][: landmarks // 4]
            negatives = negatives + [w for w in [*hard[:800], *close] for _ in range(1 + 2 * (score[w] + model.bias > -0.3))]  # the worst weigh more
        positives = sorted((witness | set(suspects)) - set(clean))
        positives += suspects + [x for s in positives[:600] if len(s) > 3 for x in _noisy(s, rng)]
        basis = _Landmarks(marks)
        x = basis.embed(positives + negatives)
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        model = basis.fold(*_svm(x, y, 1000.0, 300 if k == rounds - 1 else 120))  # the first rounds only find the next strings
    pairs = [everything[i] for i in sorted(hidden)] + bags[:: max(1, len(bags) // 600)]
    score = _lookup(model, {w for b, _, _ in pairs for w in b})
    worst = [max(b, key=lambda w: (score[w], w), default="") for b, _, _ in pairs]
    best, which = model.with_phrases((spelled(words) for _, _, words in pairs), np.array([score.get(w, 0.0) for w in worst]))
    worst, margins = [which.get(k, w) for k, w in enumerate(worst)], best.tolist()
    labels = [y for _, y, _ in pairs]
    # every sixth toxic text counts again with its worst string disguised, which lowers the threshold a little
    shown = [w for w, m, y in zip(worst, margins, labels, strict=True) if y and m + model.bias > 0 and len(w) > 3]
    hidden_words = [_noisy(w, rng)[k % 2] for k, w in enumerate(shown[::6])]
    margins += model.margins(hidden_words).tolist()
    labels += [1] * len(hidden_words)
    model.slope, model.bias = _sigmoid(np.array(margins), np.array(labels, dtype=float))
    return model


class _Phrases:
    """The phrases of labelled texts (numbers of a vocabulary) as numbers, with the number of texts of each class that have them."""

    def __init__(self, texts: list[tuple[np.ndarray, int]], vocabulary: dict[str, int]):
        self.texts, self.ids, self.words = texts, vocabulary, list(vocabulary)
        self.count = {}
        for y in (0, 1):
            keys = [np.unique(self.keys(words)) for words, z in texts if z == y]
            self.count[y] = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True)

    @staticmethod
    def keys(text: np.ndarray) -> np.ndarray:
        """A 64-bit number for each window of two words, then of three, and so on."""
        ids = text.astype(np.uint64) + np.uint64(1)
        out, key = [], ids
        for k in range(1, PHRASE):
            key = key[: max(0, len(ids) - k)] * np.uint64(0x9E3779B97F4A7C15) + ids[k:]
            key ^= key >> np.uint64(29)
            out.append(key)
        return np.concatenate(out)

    def key(self, phrase: str) -> np.ndarray:
        """The number of one phrase; a word that no text has makes it one that none has."""
        return self.keys(np.array([self.ids.get(w, -1) for w in phrase.split(MARK)], dtype=np.int64))[-1:]

    def names(self, text: np.ndarray, at: np.ndarray) -> list[str]:
        """The phrases at places of keys(text)."""
        out = []
        for i in at.tolist():
            k = 2
            while i >= len(text) - k + 1:
                i -= len(text) - k + 1
                k += 1
            out.append(MARK.join(self.words[j] for j in text[i : i + k].tolist()))
        return out

    def times(self, keys: np.ndarray, y: int) -> np.ndarray:
        """In how many texts of a class each phrase is."""
        known, n = self.count[y]
        if not len(known):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, n[at], 0)

    def clean(self, phrase: str) -> bool:
        return bool(self.times(self.key(phrase), 0).any())

    def doubtful(self, scale: float, words: set[str]) -> tuple[dict[int, set[str]], dict[str, int]]:
        """Phrases far more frequent in toxic texts than clean ones let expect: by text, and in how many clean texts.

        One that holds a doubtful word or a shorter doubtful phrase is explained by that.
        """
        keys, k = self.count[1]
        keys, k = keys[k > 1], k[k > 1]
        in_clean = self.times(keys, 0)
        expected = (in_clean + 0.5) * scale
        bar = 3.0 + 0.5 * np.log10(1 + len(keys))
        wanted = keys[((k - expected) / (expected + 1) ** 0.5 > bar) & (k > 6 * in_clean * scale)]
        found: dict[int, set[str]] = {}
        for i, (text, y) in enumerate(self.texts):
            if y and len(wanted):
                names = self.names(text, np.flatnonzero(np.isin(self.keys(text), wanted)))
                found[i] = {p for p in names if not words.intersection(p.split(MARK))}
        every = {p for s in found.values() for p in s}

        def plain(p: str) -> bool:
            w = p.split(MARK)
            return not any(MARK.join(w[a:b]) in every for a in range(len(w)) for b in range(a + 2, len(w) + 1) if b - a < len(w))

        every = {p for p in every if plain(p)}
        return {i: s & every for i, s in found.items()}, {p: int(self.times(self.key(p), 0)[0]) for p in every}

    def sample(self, y: int, n: int, rng: np.random.Generator) -> list[str]:
        """About ``n`` phrases of a class's texts."""
        texts = [words for words, z in self.texts if z == y and len(words) > 1]
        out = []
        for i in (rng.integers(0, len(texts), n).tolist() if texts else []):
            words = texts[i]
            a, k = int(rng.integers(0, len(words) - 1)), int(rng.integers(2, PHRASE + 1))
            out.append(MARK.join(self.words[j] for j in words[a : a + k].tolist()))
        return sorted(set(out))


class _Landmarks:
    """The Nystrom map of a list of landmark strings: k(x, landmarks) times K_mm^(-1/2)."""

    def __init__(self, marks: list[str]):
        maps = [feature_map(m) for m in marks]
        self.triples = {t: i for i, t in enumerate(sorted({t for m in maps for t in m}))}
        self.phi = np.zeros((len(marks), len(self.triples)))
        for i, m in enumerate(maps):
            for t, v in m.items():
                self.phi[i, self.triples[t]] = v
        values, vectors = np.linalg.eigh(self.phi @ self.phi.T)
        keep = values > 1e-6 * values.max()
        self.half = vectors[:, keep] / np.sqrt(values[keep])
        self.alphabet = np.array(sorted({c for t in self.triples for c in t}), dtype=np.int64)
        self.size = len(self.alphabet) + 1
        at = {c: i + 1 for i, c in enumerate(self.alphabet.tolist())}
        self.place = np.array([(at[a] * self.size + at[b]) * self.size + at[c] for a, b, c in self.triples])
        self.number = _by_place(self.size, self.place, np.arange(len(self.triples)), -1)  # of the triple at a place of the table

    def _code(self, chars: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 1, 0)

    def embed(self, strings: list[str]) -> np.ndarray:
        """The features of each string, as float32, in runs of strings, so that memory is that of the result."""
        parts = []
        for i in range(0, len(strings), 200):
            part = strings[i : i + 200]
            chars, owner = _codes(part)
            code = self._code(chars)
            at, weight = [], []
            for a, b, c, o, w in _triples(np.arange(1, len(chars) + 1) * (chars > 0), owner):  # places in place of characters
                t = self.number[(code[a - 1] * self.size + code[b - 1]) * self.size + code[c - 1]]
                at.append((o * len(self.triples) + t)[t >= 0])
                weight.append(np.full(len(at[-1]), w))
            row = np.bincount(np.concatenate(at), np.concatenate(weight), minlength=len(part) * len(self.triples)).reshape(len(part), -1)
            near = (row @ self.phi.T) / np.maximum(_norms(chars, owner, len(part)), 1e-12)[:, None]
            parts.append((near @ self.half).astype(np.float32))
        return np.concatenate(parts)

    def fold(self, weights: np.ndarray, bias: float) -> ToxicityModel:
        """The model as one weight for each triple."""
        weight = (self.phi.T @ (self.half @ weights)).astype(np.float32)
        return ToxicityModel(self.alphabet, _by_place(self.size, self.place, weight, 0), bias, 3.0)


def _without_copies(bags: list[tuple[list[str], int, np.ndarray]]) -> list[tuple[list[str], int, np.ndarray]]:
    """The first of texts that agree on three or more of eight min-hashes, so copies are no extra evidence."""
    at: dict[tuple[int, int], int] = {}
    out = []
    for bag, y, words in bags:
        if not bag:
            out.append((bag, y, words))
            continue
        h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in bag], dtype=np.uint64)
        marks = [(k, int((h * np.uint64(2 * k * 0x9E3779B1 + 0x85EBCA6B) % np.uint64(4294967291)).min())) for k in range(8)]
        same = Counter(at[m] for m in marks if m in at)
        if same and max(same.values()) >= 3:
            continue
        for m in marks:
            at.setdefault(m, len(out))
        out.append((bag, y, words))
    return out


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and intercept (as a shift of the margin), with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 3.0, -1.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg))
    a, b = 3.0, -3.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([(weight * (p - target) * margin).sum(), (weight * (p - target)).sum()])
        r = weight * p * (1 - p) + 1e-9
        h = np.array([[(r * margin * margin).sum() + 1e-6, (r * margin).sum()], [(r * margin).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = max(0.1, a - step[0]), b - step[1]
    return float(a), float(b / a)


def _lookup(model: ToxicityModel, strings: set[str]) -> dict[str, float]:
    todo = sorted(strings)
    out: dict[str, float] = {}
    for i in range(0, len(todo), 4_000):
        part = todo[i : i + 4_000]
        out.update(zip(part, model.margins(part).tolist(), strict=True))
    return out


def scorer(model: ToxicityModel):
    """An Arrow UDF from text to its score; null and empty texts get the score of no string."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, float] = {}

        def margins(bags: list[set[str]]) -> np.ndarray:
            """Of each bag's most suspicious string."""
            new = sorted({w for b in bags for w in b if w not in cache})
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = sorted({w for b in bags for w in b})
            for i in range(0, len(new), 4_000):
                part = new[i : i + 4_000]
                cache.update(zip(part, model.margins(part).tolist(), strict=True))
            return np.array([max(map(cache.__getitem__, b), default=0.0) for b in bags])

        for batch in batches:
            found = []
            for texts in chunks(batch, PIECE):
                if len(texts) == 1 and len(texts[0] or "") > PIECE:
                    best, before = np.zeros(1), []
                    for piece in pieces(texts[0]):
                        words = before + words_of(piece)  # phrases may cross the cut
                        best = model.with_phrases([words], np.maximum(best, margins([strings_of(piece)])))[0]
                        before = words[1 - PHRASE :]
                    found.append(best)
                else:
                    of_words = margins([strings_of(t or "") for t in texts])
                    found.append(model.with_phrases([words_of(t or "") for t in texts], of_words)[0])
            yield pa.array(model.probability(np.concatenate([np.zeros(0), *found])))
        cache.clear()
        release()

    return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, max_chars: int = 20_000) -> ToxicityModel:
    """Trains on at most about ``rows`` labelled texts of at most ``max_chars`` characters (see labelled_texts)."""
    return fitted(labelled_texts(docs, labels, "toxic", 5, 0, rows, max_chars), train)


def with_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with each whole text's toxicity, 0 to 1, in ``column``.

    A null or empty text holds no string and scores as low as any text.  Repeated rows score alike, and ids decide nothing.
    A column of that name is replaced, all others stay; no rows give no rows.
    """
    return docs.withColumn(column, scorer(model)(F.col("text")))
