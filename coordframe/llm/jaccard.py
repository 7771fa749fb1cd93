"""N-gram Jaccard join: T-occurrence search over inverted lists, with DivideSkip.

Two documents whose shingle sets have n and m members reach similarity p/q only if they share
``T = ceil(p (n + m) / (p + q))`` shingles, so at least ``ceil(p n / q)`` of each.  DivideSkip parts a set's inverted
lists into T - L short ones, which are merged, and L long ones, which are only probed: what it looks for must
occur L times less than T among the short ones.  Three steps use this, each on what the one before has left:

* **Merge, any order.**  The lists of each set's ``n - ceil(p n / q) + l`` smallest shingles by hash (l a tenth of n) are merged by
  counting, in blocks: sets that reach the similarity meet in l of them at least.  Most documents
  are like no other and end here.  Equal sets become one class.
* **Merge, rarest first.**  The remaining classes' shingles are counted exactly.  Those that no other class has count
  against the similarity at once; lists are made of the rest of each set's ``n - ceil(p n / q) + 1`` rarest ones, and a list's member
  stays only if its place in its own order leaves room for T with another member.
* **Probe.**  A class and its candidates go to a worker, which builds the lists of the class's shingles, merges the
  short ones with a heap and probes the T - 1 longest by binary search.

Lists never become pairs of all their members.  In each round a class is compared with a few members of the largest components of
its lists that it has not met, and only lists of several components go on.  When the pairs of different components that are left are few for each list member
(LEFT_PAIRS), or after ROUNDS rounds, all of them are compared, so no link between components is lost.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, released
from .components import connected_components
from .textscan import Scan, chunks, encode, mix

WORDS, P, Q = 5, 4, 5  # similarity P/Q
BLOCK_GRAMS, PART_GRAMS = 1 << 19, 1 << 21
FILTER_BITS, LIST_ROWS, ASKED = 24, 1 << 16, 2048
ROUNDS, HUBS, LEFT_PAIRS = 8, 4, 8
_MASK = np.uint64((1 << 48) - 1)
_ZERO = np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(counts, grams, digests)``: each text's number of shingles, all 48-bit shingles (sorted by text), two 64-bit digests of each set."""
    scan = Scan([t.lower() for t in encode(texts)])  # bytes lower A-Z only
    at, h = scan.windows(WORDS)
    doc = scan.doc[at]
    short = np.flatnonzero((scan.count > 0) & (scan.count < WORDS))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(WORDS - 1):  # the whole sequence as one shingle
            has = scan.count[short] > k
            whole[has] = whole[has] * np.uint64(0x9E3779B97F4A7C15) + scan.hash[scan.first[short[has]] + k]
        h = np.r_[h, mix(whole + scan.count[short].astype(np.uint64))]
        doc = np.r_[doc, short]
    order = np.lexsort((h & _MASK, doc))
    h, doc = h[order], doc[order]
    grams = h & _MASK
    new = np.ones(len(h), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    h, grams, doc = h[new], grams[new], doc[new]
    counts = np.bincount(doc, minlength=scan.n)
    digests = np.zeros((2, scan.n), dtype=np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        np.add.at(digests[k], doc, mix(h ^ np.uint64(salt)))
    return counts, grams, mix(digests + counts.astype(np.uint64))


def pack(grams: np.ndarray) -> bytes:
    """Six bytes for each gram."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _small(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i4").tobytes(), 1)


def _values(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype="<i4").astype(np.int64)


def least(n: np.ndarray) -> np.ndarray:
    """The smallest overlap with which a set of n shingles reaches the similarity with any other."""
    return (P * n + Q - 1) // Q


def spare(n: np.ndarray) -> np.ndarray:
    """How many shared shingles the hash-ordered prefix must have beyond one that only has to meet: l."""
    return (n + 9) // 10


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, ids, at = batch.column(0), batch.column(1), 0
        for texts in chunks(batch.column(2)):
            n, grams, digests = shingle_sets(texts)
            ends = np.cumsum(n)
            raw = pack(grams)
            sets = [raw[6 * (b - k) : 6 * b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
            columns = [row.slice(at, len(texts)), ids.slice(at, len(texts)), pa.array(n), *(pa.array(d.view(np.int64)) for d in digests), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "d1", "d2", "grams"])
            at += len(texts)


_SHARED = "block long, part int, row binary, grams binary, n binary"


def _parts(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(grams) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], prefix: bool, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From sets (row, n, grams), runs of about ``size`` shingles: ``(block, rows, n, grams, owners)``; a block is named by its first row."""
    rows, sizes, raws, held = [], [], [], 0

    def block():
        n = np.array(sizes, dtype=np.int64)
        use = n - least(n) + spare(n) if prefix else n
        grams = unpack(b"".join(raws))
        out = rows[0], np.array(rows, dtype=np.int64), n, grams, np.repeat(np.arange(len(n)), use)
        rows.clear(), sizes.clear(), raws.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row, n, raw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if not n:
                    continue
                k = n - int(least(n)) + int(spare(n)) if prefix else n
                rows.append(row), sizes.append(n), raws.append(raw[: 6 * k])
                held += k
                if held >= size:
                    yield block()
                    held = 0
    if rows:
        yield block()


def _rows(columns: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "part": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.binary())) for c, x in zip(columns, names, strict=True)], names)


def _deal(parts: int, prefix: bool, size: int):
    """Each block's distinct shingles dealt to parts.

    With ``prefix``, a shingle of one set goes with its set's number (``n``: shingles of each set, then those of several, which are
    known to be shared); the block's own row (part -1) has the rows and what each set still lacks.
    Otherwise a shingle goes with its count (``n``), and the block's own row has all its sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, n, grams, owner in _blocks(batches, prefix, size):
            order = np.argsort(grams, kind="stable")
            s, o = grams[order], owner[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            count = np.diff(np.r_[first, len(s)])
            if prefix:
                several = np.repeat(count > 1, count)
                lacks = -(-least(n) // 10) - np.bincount(o[several], minlength=len(n))
                own = _small(lacks), b"", _small(n)
                who = np.where(count > 1, len(n), o[first])
            else:
                own = rows.astype("<i8").tobytes(), pack(grams), _small(n)
                who = np.zeros(len(first), dtype=np.int64)
            s = s[first]
            part = _parts(s, parts)
            by = np.lexsort((s, who, part))
            s, who, count, part = s[by], who[by], count[by], part[by]
            ends = np.searchsorted(part, np.arange(parts + 1))
            out: list[list] = [[block], [-1], [rows.astype("<i8").tobytes() if prefix else own[0]], [own[0] if prefix else own[1]], [own[2]]]
            for k in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[k], ends[k + 1]
                more = _small(np.bincount(who[a:b], minlength=len(n) + 1)) if prefix else _small(count[a:b])
                for column, x in zip(out, (block, k, None, pack(s[a:b]), more), strict=True):
                    column.append(x)
            yield _rows(out, ["block", "part", "row", "grams", "n"])

    return run


def _count(prefix: bool):
    """From dealt rows sorted by part: for each block, the number of shared shingles of each set, or a code of each shingle's count."""
    names = ["block", "part", "row", "grams", "n"]

    def answers(held: list[tuple]) -> pa.RecordBatch:
        grams = [unpack(x[3]) for x in held]
        n = [_values(x[4]) for x in held]
        sizes = [len(g) for g in grams]
        every = np.concatenate(grams)
        _, which, blocks = np.unique(every, return_inverse=True, return_counts=True)
        if prefix:  # a shingle is at most once in a block
            cuts = np.split(blocks[which] > 1, np.cumsum(sizes)[:-1])
            found = [_small(np.bincount(np.repeat(np.arange(len(k)), k)[hit], minlength=len(k))[:-1]) for hit, k in zip(cuts, n, strict=True)]
        else:
            total = np.bincount(which, np.concatenate(n))
            code = np.minimum(255, np.rint(8 * np.log2(total)) + (total > 1)).astype(np.uint8)[which]
            found = [zlib.compress(x.tobytes(), 1) for x in np.split(code, np.cumsum(sizes)[:-1])]
        return _rows([[x[0] for x in held], [x[1] for x in held], [None] * len(held), [None] * len(held), found], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for x in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if held and held[0][1] != x[1]:
                        yield answers(held)
                        held = []
                    if x[1] < 0:
                        yield _rows([[v] for v in x], names)
                    else:
                        held.append(x)
        if held:
            yield answers(held)

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From answers sorted by (block, part): rows of the sets that share enough of their prefix."""
    block, rows, lacks = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[lacks <= 0])], ["row"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for b, part, row, own, n in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if part < 0:
                    if block is not None:
                        yield done()
                    block, rows, lacks = b, np.frombuffer(row, dtype="<i8"), _values(own)
                else:
                    lacks = lacks - _values(n)
    if block is not None:
        yield done()


def _postings(parts: int):
    """From answers sorted by (block, part): the rarest shared shingles of each class, ``(gram, salt, cls, n, pos)``."""

    def postings(rows: np.ndarray, n: np.ndarray, grams: np.ndarray, coded: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(n)), n)
        every, back = np.unique(grams, return_inverse=True)
        part = _parts(every, parts)
        by = np.argsort(part, kind="stable")  # as dealt: by part, then by gram
        code = np.zeros(len(every), dtype=np.uint8)
        code[by] = np.concatenate([c for _, c in sorted(coded, key=lambda x: x[0])])
        code = code[back]
        some = code > 0
        shared = np.bincount(owner[some], minlength=len(n))
        some &= (shared >= least(n))[owner]
        g, o, c = grams[some], owner[some], code[some]
        order = np.lexsort((g, c, o))
        g, o, c = g[order], o[order], c[order]
        start = np.searchsorted(o, np.arange(len(n)))
        pos = np.arange(len(g)) - start[o] + (n - shared)[o]
        use = pos < (n - least(n) + 1)[o]
        g, o, c, pos = g[use], o[use], c[use], pos[use]
        cls = rows[o]
        salts = np.maximum(1, np.exp2(c / 8.0) / LIST_ROWS).astype(np.uint64)  # the longer a list, the more ways it is parted
        salt = (mix(cls.view(np.uint64)) % salts).astype(np.int32)
        salt[salts == 1] = -1
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(salt), pa.array(cls), pa.array(n[o].astype(np.int32)), pa.array(pos.astype(np.int32))], ["gram", "salt", "cls", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        coded: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for _, part, row, grams, n in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if part < 0:
                        if own:
                            yield postings(*own, coded)
                        own, coded = (np.frombuffer(row, dtype="<i8").astype(np.int64), _values(n), unpack(grams)), []
                    else:
                        coded.append((part, np.frombuffer(zlib.decompress(n), dtype=np.uint8)))
        if own:
            yield postings(*own, coded)

    return run


def _answered(sets: DataFrame, total: int, prefix: bool) -> tuple[DataFrame, int]:
    """``sets(row, n, grams)`` in blocks, with what was counted over all; sorted by (block, part), a block in one task."""
    spark = sets.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_GRAMS))  # a part fits a task at any size
    dealt = sets.select("row", "n", "grams").mapInArrow(released(_deal(parts, prefix, BLOCK_GRAMS)), _SHARED)
    # a block's own row stays with its block, so that no task gathers them
    by = F.when(F.col("part") < 0, F.col("block")).otherwise(F.col("part").cast("long"))
    counted = dealt.repartition(parts, by).sortWithinPartitions("part").mapInArrow(released(_count(prefix)), _SHARED)
    return counted.repartition(parts, "block").sortWithinPartitions("block", "part"), parts


def viable(seg: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which members of their lists (numbered by ``seg``, sorted by size) have a partner that may be similar.

    Members x and y can only share enough if T(n_x, n_y) shingles are left from their places on in both, so
    n_y <= M_x and n_x <= M_y with M = floor(r (p + q) / p) - n, r = n - pos.
    """
    wide = np.int64(1) << 32
    most = (n - pos) * (P + Q) // P - n
    base = seg * wide
    start = np.searchsorted(seg, seg, side="left")
    top = np.maximum.accumulate(base + np.maximum(most, 0)) - base
    before = np.r_[0, top[:-1]]
    before[start == np.arange(len(seg))] = 0
    second = np.maximum.accumulate(base + np.maximum(np.minimum(most, before), 0)) - base
    last = np.searchsorted(base + n, base + np.maximum(most, 0), side="right") - 1  # the last one that is small enough
    some = last >= start
    last = np.maximum(last, 0)
    own = (last >= np.arange(len(seg))) & (top[last] == most)
    return some & (np.where(own, second[last], top[last]) >= n)


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by ``(gram, salt, n, cls)``: list members that have a possible partner, and each one's predecessor.

    The partners of a list that is parted by salt may be in another part, so all its members stay.
    """
    names = ["gram", "cls", "n", "pos", "prev"]

    def lists(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        seg = np.cumsum(np.r_[False, new]).astype(np.int64)
        keep = viable(seg, cols[3].astype(np.int64), cols[4].astype(np.int64)) | (cols[1] >= 0)
        if not keep.any():
            return None
        seg, cols = seg[keep], [c[keep] for c in cols]
        prev = np.r_[-1, np.where(seg[1:] == seg[:-1], cols[2][:-1], -1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (cols[0], *cols[2:], prev)], names)

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.r_[a, b] for a, b in zip(held, cols, strict=True)]
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])  # the last list may go on
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut and (found := lists([c[:cut] for c in cols])) is not None:
            yield found
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]) and (found := lists(held)) is not None:
        yield found


def _filter_bit(row: np.ndarray) -> np.ndarray:
    return (mix(row.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's rows as a bit set, in one row."""
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in batches:
        bits[_filter_bit(batch.column(0).to_numpy())] = True
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["part"])


def _join_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total |= np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part"])


def _some_sets(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``sets(row, n, grams)`` of the given rows.

    A bit set of fixed size (2 MB) first, so that few others are shuffled; it only saves work, the join decides.
    """
    found = rows.mapInArrow(_filter_parts, "part binary").repartition(1).mapInArrow(_join_filters, "part binary").first()
    bits = found["part"] if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if bits is None:
            return
        wanted = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8)).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(wanted[_filter_bit(batch.column(0).to_numpy())]))

    return sets.select("row", "n", "grams").mapInArrow(run, "row long, n long, grams binary").join(rows, "row", "left_semi")


def divide_skip(query: np.ndarray, candidates: list[np.ndarray]) -> np.ndarray:
    """Which candidates (sorted gram arrays) share enough shingles with the query (sorted)."""
    n, k = len(query), len(candidates)
    sizes = np.array([len(c) for c in candidates])
    need = -(-P * (n + sizes) // (P + Q))
    grams = np.concatenate(candidates)
    who = np.repeat(np.arange(k), sizes)
    at = np.minimum(np.searchsorted(query, grams), n - 1)
    hit = query[at] == grams
    at, who = at[hit], who[hit]
    key = np.sort(at * k + who)  # each shingle's list is a run, sorted by candidate
    lengths = np.bincount(key // k, minlength=n)
    ends = np.cumsum(lengths)
    n_long = max(0, min(int(need.min()) - 1, n))
    by_length = np.argsort(-lengths, kind="stable")
    short, long = by_length[n_long:], by_length[:n_long]
    found = np.zeros(k, dtype=np.int64)
    lists = [(key[ends[s] - lengths[s] : ends[s]] % k).tolist() for s in short.tolist() if lengths[s]]
    for y in heapq.merge(*lists):
        found[y] += 1
    alive = np.flatnonzero(found >= np.maximum(need - n_long, 1))
    if len(alive) and len(long):
        probe = (long[:, None] * k + alive[None, :]).ravel()
        place = np.minimum(np.searchsorted(key, probe), len(key) - 1)
        found[alive] += (key[place] == probe).reshape(len(long), len(alive)).sum(axis=0)
    out = np.zeros(k, dtype=bool)
    out[alive] = found[alive] >= need[alive]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by query, the query's own row (other = null) first: the pairs that reach the similarity."""
    query, mine = None, _ZERO
    wait: list[tuple[int, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ok = divide_skip(mine, [g for _, g in wait])
        other = [y for (y, _), good in zip(wait, ok, strict=True) if good]
        wait.clear()
        return pa.RecordBatch.from_arrays([pa.array([query] * len(other), pa.int64()), pa.array(other, pa.int64())], ["a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for a, _, b, raw in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if wait and (b is None or len(wait) >= 256):
                    yield flush()
                if b is None:
                    query, mine = a, unpack(raw)
                else:
                    wait.append((b, unpack(raw)))
    if wait:
        yield flush()


def _linked(pairs: DataFrame, arrays: DataFrame, many: bool) -> DataFrame:
    """The pairs ``(a, b)`` that reach the similarity; if a query may have ``many`` candidates, they go to a task for each ASKED of them."""
    pairs = pairs.withColumn("ways", F.lit(1))
    if many:
        asked = pairs.groupBy("a").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("ways"))
        pairs = pairs.drop("ways").join(asked, "a")
    mine = pairs.groupBy("a").agg(F.first("ways").alias("ways")).select(F.col("a").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way")).join(arrays, "cls")
    theirs = pairs.withColumn("way", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int")).join(arrays.withColumnRenamed("cls", "b"), "b")
    rows = mine.select(F.col("cls").alias("a"), "way", F.lit(None).cast("long").alias("b"), "grams").unionByName(theirs.select("a", "way", "b", "grams"))
    return rows.repartition("a", "way").sortWithinPartitions("a", "way", F.col("b").asc_nulls_first()).mapInArrow(_verify, "a long, b long")


def _open_lists(rows: DataFrame, comp: DataFrame, seed: int) -> DataFrame:
    """List members with their component, of lists with several; and the list's size, sum of squares over components, and largest component with two members.

    One is the member with the smallest place for this shingle, so with the fewest shingles of its own: what others are copies of.  The other is picked by hash.
    """
    rows = rows.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    by_comp = rows.groupBy("gram", "component").agg(F.count("*").alias("k"), F.min_by("cls", F.struct("pos", "cls")).alias("centre"), F.min_by("cls", F.xxhash64("cls", F.lit(seed))).alias("other"))
    largest = F.max_by(F.struct(F.col("component").alias("main"), "centre", "other"), F.struct("k", "component")).alias("s")
    lists = by_comp.groupBy("gram").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("own"), F.count("*").alias("m"), largest)
    return rows.join(lists.where("m > 1").select("gram", "size", "own", "s.*"), "gram")


def _hubs(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """For each class outside its list's largest component, the HUBS members of such components that most of its lists offer, none twice."""
    offers = rows.where("component <> main").select("cls", F.explode(F.array_distinct(F.array("centre", "other"))).alias("hub"))
    offers = offers.groupBy("cls", "hub").agg(F.count("*").alias("k"))
    offers = offers.join(tried.select(F.col("a").alias("cls"), F.col("b").alias("hub")), ["cls", "hub"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("k"), "hub"))
    return offers.withColumn("rank", rank).where(F.col("rank") <= HUBS).select(F.col("cls").alias("a"), F.col("hub").alias("b"))


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Words are lower-cased (A-Z only) runs of non-space; a document is its set of five-word
    shingles, or its whole sequence as one if shorter.  Documents link when 100 * |intersection| >= 80 * |union|;
    component_id is the smallest doc_id reachable.  Null, empty and blank texts have no shingle
    and link with nothing.  Repeated rows are equal sets and link; rows of one id with unlike texts don't.  No rows give no rows,
    other columns are not looked at.  Sets are told apart by 128-bit digests of 64-bit shingles, and pairs compared by 48 bits of each shingle.
    """
    ws = Workspace(spark, "jaccard")
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = ws.table("sets", keyed.mapInArrow(released(_sets), "row long, doc_id long, n long, d1 long, d2 long, grams binary"))
    ids, full = sets.select("row", "doc_id", "n", "d1", "d2"), sets.where("n > 0")
    total = full.agg(F.sum(F.col("n") - F.floor(F.col("n") * P / Q) + F.floor(F.col("n") / 10)).alias("k")).first()["k"] or 0
    answers, _ = _answered(full, total, True)
    alike = ws.table("alike", answers.mapInArrow(_alike, "row long"))
    # equal sets are one class, named by its smallest row
    alike_ids = alike.join(ids, "row")
    classes = alike_ids.groupBy("d1", "d2", "n").agg(F.min("row").alias("cls"))
    members = ws.table("members", alike_ids.join(classes, ["d1", "d2", "n"]).select("row", "doc_id", "cls"))
    arrays = ws.table("arrays", _some_sets(sets, members.select(F.col("cls").alias("row")).distinct()))
    total = arrays.agg(F.sum("n").alias("k")).first()["k"] or 0
    answers, parts = _answered(arrays, total, False)
    postings = answers.mapInArrow(released(_postings(parts)), "gram long, salt int, cls long, n int, pos int")
    lists = postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "n", "cls").mapInArrow(_shared_lists, "gram long, cls long, n int, pos int, prev long")
    lists = ws.table("lists", lists)
    sets_of = ws.table("listed", arrays.select(F.col("row").alias("cls"), "grams").join(lists.select("cls").distinct(), "cls", "left_semi"))
    ws.drop("alike", "arrays")

    # first round: each class and the predecessor that it has in most of its lists
    near = lists.where("prev >= 0").groupBy("cls", "prev").agg(F.count("*").alias("k")).groupBy("cls").agg(F.max_by("prev", F.struct("k", "prev")).alias("b"))
    tried = ws.table("tried0", near.select(F.col("cls").alias("a"), "b"))
    edges = ws.table("edges0", _linked(tried, sets_of, False))
    comp = ws.table("comp0", connected_components(spark, edges))
    rows, few, tables = lists.drop("prev"), LEFT_PAIRS * lists.count(), ["tried0", "edges0", "comp0"]
    for k in range(1, ROUNDS + 2):
        rows = ws.table(f"open{k}", _open_lists(rows, comp, k))
        tables.append(f"open{k}")
        left = rows.agg(F.sum(F.col("size") - F.col("own") / F.col("size")).alias("pairs")).first()["pairs"] or 0  # ordered pairs of different components
        if not left:
            break
        last = k > ROUNDS or left <= few
        if last:  # members of one list that lie in different components
            room = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) * (P + Q) >= (F.col("l.n") + F.col("r.n")) * P
            pairs = rows.alias("l").join(rows.alias("r"), (F.col("l.gram") == F.col("r.gram")) & (F.col("l.component") < F.col("r.component")) & room)
            pairs = pairs.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct()
        else:
            pairs = ws.table(f"tried{k}", _hubs(rows, tried))
            tried = tried.unionByName(pairs)
            tables.append(f"tried{k}")
        edges = edges.unionByName(ws.table(f"edges{k}", _linked(pairs, sets_of, last)))
        comp = ws.table(f"comp{k}", connected_components(spark, edges))
        tables += [f"edges{k}", f"comp{k}"]
        rows = rows.select("gram", "cls", "n", "pos")
        if last:
            break
    classes = members.groupBy("cls").agg(F.min("doc_id").alias("low"))
    classes = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = classes.join(classes.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("cls", "component_id")
    named = members.join(named, "cls").select("row", "component_id")
    out = ids.select("row", "doc_id", F.col("n").alias("n_shingles")).join(named, "row", "left")
    out = ws.table("out", out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    ws.drop("sets", "members", "lists", "listed", *tables)
    return out
