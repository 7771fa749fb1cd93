"""Best-fit packing with exact-complement hashing.

Documents become token sequences; only those longer than the capacity are cut.  Packing needs the
number of pieces of each length and nothing else, so the plan is made on the driver from at most
``capacity`` counts: for the gap that a longest piece leaves, lengths that fill it exactly are looked up
in indexes of single lengths, pair sums and triple sums, and used as often as all
their counts allow; what is left is packed best-fit, longest first.  Each length's pieces are then
ranked in parallel and find their sequence and offset by their rank.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, released

CAPACITY, SEPARATOR, PARTS, CACHE = 2048, 0, 64, 150_000


#: How the word tokenizer splits a normalised text; a fixed value of its file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = b"\xff"  # stands for the end of a word; no UTF-8 text has this byte
#: Words that lower-casing and composition treat character by character: printable Latin without the dotted capital I.
_LATIN = r"!-~\u00a1-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[{_LATIN}]+")
#: The same of whole texts, with the white space that separates words.
_PLAIN_TEXT = re.compile(rf"[\t-\r {_LATIN}]*")


def _marks() -> tuple[str, str]:
    """Plain characters that are numbers, and those that are neither letters nor numbers."""
    plain = [(unicodedata.category(c)[0], c) for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c)]
    return "".join(c for kind, c in plain if kind == "N"), "".join(c for kind, c in plain if kind not in "LN")


_NUMBERS, _OTHERS = _marks()
#: What SPLIT matches in lower-cased plain words besides runs of letters.
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{re.escape(_NUMBERS)}]|[{re.escape(_OTHERS)}]+")


class _Merges:
    """Byte-pair merges as ranks of the merged bytes, for a faster encoder than the file's own library.

    Ranks are equivalent to merges if every token, merged on its own, ends as that token: before the
    last merge its span then holds the pair that its merge names, whatever stands around it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = [x for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        normal = [x["type"] for x in spec["normalizer"].get("normalizers", [])] if spec["normalizer"] else []
        self.usable = (
            model["type"] == "BPE"
            and model.get("end_of_word_suffix") == "</w>"
            and not model.get("ignore_merges")
            and not model.get("dropout")
            and normal == ["NFC", "Replace", "Lowercase"]
            and [x["pattern"].get("Regex") for x in split] == [SPLIT]
        )
        self.ranks: dict[bytes, int] = {}
        self.ids: list[int] = []
        if not self.usable:
            return
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if ends else token)) + (_END if ends else b"")

        special = {t["content"] for t in spec["added_tokens"]}
        self.special = tuple(special)
        known = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.pairs: dict[tuple[bytes, bytes], int] = {}
        for x in [bytes([b]) + _END for b in range(255)] + [bytes([b]) for b in range(256)]:
            self._add(x, known.get(x, -1))
        for m in model["merges"]:
            a, b = (raw(t) for t in (m if isinstance(m, list) else m.split(" ")))
            if a + b in self.ranks:
                self.usable = False
                return
            self.pairs[a, b] = len(self.ids)
            self._add(a + b, known[a + b])

    def _add(self, token: bytes, number: int) -> None:
        self.ranks[token] = len(self.ids)
        self.ids.append(number)

    def merged(self, token: bytes) -> list[bytes]:
        """The merges themselves, one after the other."""
        parts = [bytes([b]) for b in token]
        if token.endswith(_END) and len(token) > 1:
            parts[-2:] = [token[-2:]]
        while len(parts) > 1:
            rank, k = min((self.pairs.get(pair, 1 << 30), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def proven(self) -> bool:
        """Whether ranks give the merges' result for every text."""
        return self.usable and all(self.merged(a + b) == [a + b] for a, b in self.pairs)


class _Known(dict):
    """Remembered ids; those of a lower-cased plain word (str) that is not there come from the older generation, or from its parts by SPLIT."""

    def __init__(self, older: dict, make: Callable[[str], bytes]):
        super().__init__()
        self.older, self.make = older, make

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if word.isalpha():
                found = self.make(word)
            elif (stem := word.rstrip(_OTHERS)).isalpha():  # marks behind letters are one part
                found = self[stem] + self[word[len(stem) :]]
            else:
                parts = _CUT.sub(r" \g<0> ", word).split()
                found = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self.make(word)
        self[word] = found
        return found


class _Ids:
    """Token ids of words as little-endian bytes; words are white-space separated, which no token crosses.

    Words (str if plain, else bytes) and the parts that SPLIT makes of plain ones are remembered in two generations: when the
    younger is full it replaces the older, so frequent ones stay and memory is bounded.
    """

    def __init__(self, path: str, fast: bool, merges: tuple[dict[bytes, int], list[int], tuple[str, ...]] | None = None):
        """``merges``: the ranks, ids and special tokens of the file's _Merges, if they are at hand."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.old, self.young = path, {}, _Known({}, self._part)
        self.piece, self.split, self.special = None, None, ()
        if fast:
            import regex
            import tiktoken

            if merges is None:
                made = _Merges(path)
                merges = made.ranks, made.ids, made.special
            ranks, ids, self.special = merges
            core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.piece, self.ids = core.encode_single_piece, np.array(ids, dtype=np.int64).astype("<u4")
            raw = self.ids.tobytes()
            self.id_of = [raw[k : k + 4] for k in range(0, len(raw), 4)].__getitem__
            self.split = regex.compile(SPLIT).findall

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.id_of, self.piece(part.encode() + _END)))

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        slow, flat, done = [], [], []
        piece, plain, split, special = self.piece, _PLAIN.fullmatch, self.split, self.special
        for k, w in enumerate(words):
            if w.isalpha() and piece is not None:  # bytes: ASCII letters only
                flat += piece(w.lower() + _END)
                done.append((k, 4 * len(flat)))
                continue
            t = w.decode("utf-8", "replace")
            if piece is None or not plain(t) or ("<" in t and any(x in t for x in special)):
                slow.append((k, t))
                continue
            low = t.lower()
            if low.isalpha():
                flat += piece(low.encode() + _END)
            else:
                for x in split(low):
                    flat += piece(x.encode() + _END)
            done.append((k, 4 * len(flat)))
        if done:
            raw, start = self.ids[flat].tobytes(), 0
            for k, end in done:
                out[k] = raw[start:end]
                start = end
        found = self.tokenizer.encode_batch([t for _, t in slow], add_special_tokens=False) if slow else []
        for (k, _), x in zip(slow, found, strict=True):
            out[k] = np.array(x.ids, dtype="<u4").tobytes()
        return out

    def texts(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, _Known(self.young, self._part)
            self.old.older = {}
        out, rest = [], []
        for k, t in enumerate(texts):
            if self.piece is None or not _PLAIN_TEXT.fullmatch(t := t or "") or ("<" in t and any(x in t for x in self.special)):
                rest.append(k)
                out.append(b"")
            else:
                out.append(b"".join(map(self.young.__getitem__, t.lower().split())))
        if rest:
            for k, raw in zip(rest, self._by_words([texts[k] for k in rest]), strict=True):
                out[k] = raw
        return out

    def _by_words(self, texts: list[str | None]) -> list[bytes]:
        """Word by word: texts that hold more than plain characters."""
        words = [(t or "").encode("utf-8", "replace").split() for t in texts]
        young, old = self.young, self.old
        new = []
        for w in {w for ws in words for w in ws}:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        young.update(zip(new, self.encode(new), strict=True))
        get = young.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` and, unless ``keep_ids`` is false, ``ids``.

    Each whole text's ids end with SEPARATOR; a null text is empty, so it is the separator alone.
    Every piece but a document's last has ``capacity`` tokens.  ``tokenizer`` is a file of the tokenizers
    library that drops white space and exists on every worker.
    """
    merges = _Merges(tokenizer)
    fast, known = merges.proven(), (merges.ranks, merges.ids, getattr(merges, "special", ()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(tokenizer, fast, known)
        tail, step = np.array([SEPARATOR], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for doc_id, raw in zip(part.column(0).to_pylist(), ids.texts(part.column(1).to_pylist()), strict=True):
                    raw += tail
                    for k in range(0, len(raw), step):
                        cut = raw[k : k + step]
                        row = (doc_id, k // step, k // 4, len(cut) // 4, zlib.crc32(cut))
                        rows.append(row + (np.frombuffer(cut, dtype="<u4").astype(np.int32),) if keep_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), ddl)


class _Plan:
    """Patterns ``(lengths, times)``, made while counts last."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts.astype(np.int64).copy(), capacity
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._index: tuple[int, int, int] | None = None

    def use(self, lengths: tuple[int, ...]) -> None:
        """The pattern as often as the counts allow; it uses up at least one length."""
        need = Counter(lengths)
        times = min(int(self.left[n]) // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= k * times
            if not self.left[n]:
                self._index = None
        self.patterns.append((lengths, times))

    def enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[n] >= k for n, k in Counter(lengths).items())

    def index(self) -> tuple[int, int, int]:
        """Bit sets of the sums of one, two and three lengths that are left: bit t is set if some add up to t.

        They are made anew when a length runs out.  A sum may need more of a length than there is, so availability is checked apart.
        """
        if self._index is None:
            there = np.flatnonzero(self.left > 0).tolist()
            one = sum(1 << n for n in there)
            two = three = 0
            for n in there:
                two |= one << n
            two &= (2 << self.capacity) - 1
            for n in there:
                three |= two << n
            self._index = one, two, three & (2 << self.capacity) - 1
        return self._index

    def pair(self, total: int, first: tuple[int, ...], most: int) -> tuple[int, int] | None:
        """Two lengths that add up to ``total`` and are left beside those in ``first``; the longest first."""
        b = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        if not len(b):
            return None
        for n in b[(self.left[b] > 0) & (self.left[total - b] > 0)].tolist():
            if self.enough((*first, n, total - n)):
                return n, total - n
        return None

    def exact(self, a: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap beside ``a``: one, two or three, looked up in the indexes of sums."""
        gap = self.capacity - a
        one, two, three = (x >> gap & 1 for x in self.index())
        if one and self.enough((a, gap)):
            return (a, gap)
        if two and (found := self.pair(gap, (a,), gap - 1)):
            return (a, *found)
        if three:
            pairs = self.index()[1]
            for b in range(gap - 2, (gap + 2) // 3 - 1, -1):
                if self.left[b] > 0 and pairs >> (gap - b) & 1 and (found := self.pair(gap - b, (a, b), b)):
                    return (a, b, *found)
        return None

    def best_fit(self) -> None:
        """What is left, longest first, each piece into the open sequence with the smallest gap that holds it.

        Pieces of one length and sequences of one gap are handled together.  A sequence that has taken a piece has the smallest gap
        of all, so it takes that length as often as it can.
        """
        gaps: list[int] = []  # in order
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

        def put(lengths: tuple[int, ...], gap: int, times: int) -> None:
            if gap not in open_:
                bisect.insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((lengths, times))

        for n in np.flatnonzero(self.left > 0).tolist()[::-1]:
            left = int(self.left[n])
            while left:
                at = bisect.bisect_left(gaps, n)
                if at == len(gaps):
                    lengths, times, gap = (), left, self.capacity
                else:
                    gap = gaps[at]
                    lengths, times = open_[gap].pop()
                    if not open_[gap]:
                        del open_[gap], gaps[at]
                each = gap // n
                full = min(times, left // each)
                if full:
                    put(lengths + (n,) * each, gap - n * each, full)
                left -= full * each
                if full < times and left:  # fewer pieces than one more sequence could take
                    put(lengths + (n,) * left, gap - n * left, 1)
                    full, left = full + 1, 0
                if lengths and full < times:
                    put(lengths, gap, times - full)
        self.left[:] = 0
        self.patterns += [p for ps in open_.values() for p in ps]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How often to fill a sequence with which lengths; ``counts[n]`` pieces have length n."""
    p = _Plan(counts, capacity)
    if p.left[capacity]:
        p.use((capacity,))
    for a in range(capacity - 1, 0, -1):
        while p.left[a] and (found := p.exact(a)):
            p.use(found)
    p.best_fit()
    return p.patterns


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run, that run's first sequence, and its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: the place of each piece in gapless sequences.

    ``pieces`` has a ``length`` from 1 to ``capacity`` in each row; other columns go along, but columns named
    sequence_id or offset are replaced.  Every row is placed once, repeated rows too.  No rows give no rows.
    """
    ws = Workspace(spark, "packing")
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row"), F.struct(*kept).alias("piece"))
    rows = ws.table("pieces", rows.withColumn("part", F.pmod("row", F.lit(PARTS)).cast("int")))
    parts = ws.table("counts", rows.groupBy("length", "part").agg(F.count("*").alias("k")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in parts.groupBy("length").agg(F.sum("k").alias("k")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["k"]
    counts[capacity] = 0  # a full piece is a sequence of its own, and its row's number names it
    patterns = plan(counts, capacity)
    places, used = _places(patterns), sum(times for _, times in patterns)
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        order = np.argsort(n, kind="stable")
        values, first = np.unique(n[order], return_index=True)
        for value, at in zip(values.tolist(), np.split(order, first[1:]), strict=True):
            start, base, shift = places[value]
            run = np.searchsorted(start, r[at], side="right") - 1
            sequence[at], offset[at] = base[run] + r[at] - start[run], shift[run]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], fields=list(kind))

    full = rows.where(F.col("length") == capacity).select("piece.*", (F.col("row") + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = parts.select("length", "part", (F.sum("k").over(Window.partitionBy("length").orderBy("part")) - F.col("k")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    ranked = rows.where(F.col("length") < capacity).withColumn("rank", rank).join(F.broadcast(before), ["length", "part"])  # capacity * PARTS rows at most
    ranked = ranked.withColumn("place", place(F.col("length"), F.col("rank") + F.col("before")))
    return ranked.select("piece.*", "place.sequence_id", "place.offset").unionByName(full)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every document's pieces with their ids, packed into as few sequences as the method finds.

    Null and empty texts are the separator alone.  Null and repeated ids are packed as any others; no rows give no rows; other columns of ``docs``
    are not looked at.
    """
    return pack_pieces(spark, tokenize(docs, tokenizer, capacity, keep_ids), capacity)
