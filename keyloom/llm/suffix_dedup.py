"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts earlier are removed.

A suffix array over a whole corpus would hold a suffix for each byte. Instead
each window of SPAN bytes names an anchor, the smallest of the hashes of its
GRAM-byte substrings (leftmost among equals). Equal windows have equal anchors
at equal offsets, so a window can only repeat if its anchor does, and anchors
that occur once in the corpus are dropped by one aggregation and one join. Of
the contexts of an anchor that have equal hashes the first is kept; the others are
copies of it, joined along their documents to long ranges, each compared with
the range that it copies by the SHA-256 of its bytes. What is kept of an anchor is
sorted as suffixes: comparisons find the common
extension of two suffixes by binary search on prefix polynomial hashes, in a
mergesort that runs over all anchors of a chunk at once; common prefixes of
neighbours are then verified on the bytes. Neighbours with enough in common to
the right, and equal hashes to the left, are equal windows, of which all but the
first go; what is equal to the left is verified on the bytes, too.

An anchor of more than HOT different contexts would make one large group, which
one task had to sort. Its windows are grouped by the SHA-256 of their bytes
instead, which Spark combines before the shuffle and can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

SPAN, GRAM = 100, 40
#: k-grams of a window.
WIDTH = SPAN - GRAM + 1
HOT = 2_000
#: Suffixes sorted at once, about.
SORT_ROWS = 20_000
#: Anchors are chosen by the upper half of their hashes; the lower half holds the position, which decides between equals.
_AT = (1 << 32) - 1
#: Packed values hold a place in the document below the mark of its text.
_PLACE = (1 << 46) - 1
#: Bytes of text whose anchors are found, and whose contexts are cut out, at once.
ANCHOR_BYTES, CONTEXT_BYTES = 1 << 19, 1 << 18
#: Rows of null keys are documents by their text's hash, before those of any key above this.
NULL_KEYS = -(2**62)


class Anchors:
    """Anchors of some documents: position, and the starts of the first and the last window that names each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        self.prefix = C.prefix_hashes(data)
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.doc = none
        self.hash = np.zeros(0, np.uint64)
        if n < SPAN:
            return
        starts = np.arange(n - GRAM + 1)
        low = C.mix(C.span_hashes(self.prefix, starts, starts + GRAM))
        packed = (low & np.uint64(~_AT & (2**64 - 1))) | starts.astype(np.uint64)
        size, least = 1, packed
        while 2 * size <= WIDTH:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        least = np.minimum(least[: n - SPAN + 1], least[WIDTH - size : WIDTH - size + n - SPAN + 1])
        at = (least & np.uint64(_AT)).astype(np.int64)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: n - SPAN + 1]
        whole = np.flatnonzero(np.arange(n - SPAN + 1) + SPAN <= off[1:][doc])
        at, doc = at[whole], doc[whole]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        self.at, self.doc, self.first = at[begin], doc[begin], whole[begin]
        self.last = whole[np.concatenate((begin[1:], [len(at)])) - 1] if len(at) else none
        self.hash = low[self.at]


def pack(at: np.ndarray, first: np.ndarray, last: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One long: 16 bits that tell rows of one key apart, position in the document, distance to the first window, windows less one."""
    return (mark.astype(np.int64) << 46) | (at.astype(np.int64) << 14) | ((at - first).astype(np.int64) << 7) | (last - first).astype(np.int64)


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, distance to the first window, windows)."""
    return (x >> 14) & 0xFFFFFFFF, (x >> 7) & 127, (x & 127) + 1


def _marks(data: np.ndarray, off: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return (C.mix(C.span_hashes(prefix, off[:-1], off[1:]) + np.diff(off).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)


def anchors(rows: DataFrame) -> DataFrame:
    """(h, g, k, x): every anchor of every document (_kl_k key, _kl_t text); g is a hash of all its windows together, its context."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, "_kl_t"))
            keys = np.asarray(C.column(batch, "_kl_k"))
            for lo, hi in C.chunks(off, ANCHOR_BYTES):
                raw, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                a = Anchors(raw, o)
                x = pack(a.at - o[a.doc], a.first - o[a.doc], a.last - o[a.doc], _marks(raw, o, a.prefix)[a.doc])
                shape = ((a.at - a.first) * 128 + a.last - a.first).astype(np.uint64)
                g = C.mix(C.span_hashes(a.prefix, a.first, a.last + SPAN) + C.mix(shape))
                yield pa.RecordBatch.from_arrays([pa.array(a.hash.view(np.int64)), pa.array(g.view(np.int64)), pa.array(keys[lo + a.doc]), pa.array(x)], ["h", "g", "k", "x"])

    return rows.mapInArrow(work, "h long, g long, k long, x long")


_CONTEXTS = T.StructType([T.StructField("kind", T.IntegerType())] + [T.StructField(x, T.LongType()) for x in "hkxy"] + [T.StructField("c", T.BinaryType())])


def _record(kind: int, h, k, x, y, c: pa.Array) -> pa.RecordBatch:
    n = len(k)
    zero = np.zeros(n, np.int64)
    own = [pa.array(np.full(n, kind, np.int32))] + [pa.array(zero if v is None else np.ascontiguousarray(v, dtype=np.int64)) for v in (h, k, x, y)]
    return pa.RecordBatch.from_arrays([*own, c], _CONTEXTS.names)


def contexts(rows: DataFrame) -> DataFrame:
    """Of the documents' listed anchors (_a: their x, _s: whether each is hot, _h) and of ranges that others copy (_o: start with the mark, _n: bytes): rows of three kinds.

    1: a suffix to sort, c its anchor's windows. 2: a window at x of a hot anchor, c its SHA-256. 3: a range at x of y bytes, c its SHA-256.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, "_kl_t"))
            keys = np.asarray(C.column(batch, "_kl_k"))
            for lo, hi in C.chunks(off, CONTEXT_BYTES):
                raw, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                prefix = C.prefix_hashes(raw)
                marks = _marks(raw, o, prefix)
                (start, size), doc = _lists(batch, ["_o", "_n"], lo, hi)
                own = (start >> 46) == marks[doc]
                start, size, doc = start[own], size[own], doc[own]
                if len(start):
                    yield _record(3, None, keys[lo + doc], start, size, _digests(raw, o[doc] + (start & _PLACE), size))
                (x, h, hot), doc = _lists(batch, ["_a", "_h", "_s"], lo, hi)
                own = (x >> 46) == marks[doc]
                x, h, hot, doc = x[own], h[own], hot[own], doc[own]
                order = np.lexsort((x, keys[lo + doc]))
                x, doc, h, hot = x[order], doc[order], h[order], hot[order]
                at, left, n = unpack(x)
                k, mark, begin, p = keys[lo + doc], marks[doc] << 46, o[doc] + at - left, at - left
                b = begin + n - 1 + SPAN
                cold = np.flatnonzero(hot == 0)
                if len(cold):
                    size = (b - begin)[cold]
                    ends = np.cumsum(size)
                    bytes_ = raw[np.repeat((begin[cold] - (ends - size)).astype(np.int32), size) + np.arange(int(ends[-1]), dtype=np.int32)]
                    c = pa.BinaryArray.from_buffers(pa.binary(), len(cold), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(bytes_.tobytes())])
                    yield _record(1, h[cold], k[cold], x[cold], None, c)
                warm = np.flatnonzero(hot != 0)
                if len(warm):
                    which = np.repeat(warm, n[warm])
                    step = np.arange(len(which)) - np.repeat(np.cumsum(n[warm]) - n[warm], n[warm])
                    yield _record(2, None, k[which], mark[which] | (p[which] + step), None, _digests(raw, begin[which] + step, np.full(len(which), SPAN)))

    return rows.mapInArrow(work, _CONTEXTS)


def _lists(batch: pa.RecordBatch, names: list[str], lo: int, hi: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The values of list columns (null for none) of rows lo to hi, and the row of each, from 0."""
    columns = [C.column(batch, x)[lo:hi] for x in names]
    n = np.asarray(columns[0].value_lengths().fill_null(0)).astype(np.int64)
    return [np.asarray(x.flatten()).astype(np.int64) for x in columns], np.repeat(np.arange(hi - lo), n)


def _digests(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    view = memoryview(raw)
    return pa.array([hashlib.sha256(view[a : a + n]).digest() for a, n in zip(start.tolist(), size.tolist())], pa.binary())


def joined_copies(rows: DataFrame) -> DataFrame:
    """(k, x, y, k0, x0): copied ranges (lists x, y, k0, x0 of each k) of one source and shift, joined where they touch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, y, k0, x0), doc = _lists(batch, ["x", "y", "k0", "x0"], 0, batch.num_rows)
            shift = x0 - x  # of places with their marks, of which there is one for each source
            order = np.lexsort((x, shift, k0, x >> 46, doc))
            x, y, k0, x0, shift, doc = (v[order] for v in (x, y, k0, x0, shift, doc))
            new = np.ones(len(x), dtype=bool)
            end = (x & ~_PLACE) + y
            new[1:] = (doc[1:] != doc[:-1]) | (k0[1:] != k0[:-1]) | (shift[1:] != shift[:-1]) | (x[1:] > end[:-1])
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(x)])) - 1 if len(x) else first
            keys = np.asarray(C.column(batch, "k"))[doc[first]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys, x[first], y[last], k0[first], x0[first])], ["k", "x", "y", "k0", "x0"])

    return rows.mapInArrow(work, "k long, x long, y long, k0 long, x0 long")


class _Suffixes:
    """Suffixes at the anchors of some contexts, compared on prefix hashes."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, rank: np.ndarray):
        self.data, self.begin, self.length, self.rank = data, begin, length, rank
        self.prefix = C.prefix_hashes(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search."""
        low, high = np.zeros(len(i), dtype=np.int64), np.minimum(self.length[i], self.length[j])
        a, b = self.begin[i], self.begin[j]
        _, down = C.powers(len(self.prefix))
        da, db, pa_, pb = down[a], down[b], self.prefix[a], self.prefix[b]
        for _ in range(SPAN.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - pa_) * da == (self.prefix[b + middle] - pb) * db
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; of equal suffixes the one of the lower rank does."""
        m = self.common(i, j)
        over_i, over_j = m == self.length[i], m == self.length[j]
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.begin[i] + m, last)], self.data[np.minimum(self.begin[j] + m, last)]
        tie = self.rank[i] < self.rank[j]
        return np.where(over_i & over_j, tie, np.where(over_i, True, np.where(over_j, False, x < y)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (groups stand together): a mergesort, each pass of which merges all runs of all groups."""
        n = len(group)
        order = np.arange(n)
        begin = np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - begin
        run = 1
        while True:
            act = np.flatnonzero(size > run)
            if not len(act):
                return order
            place = act - begin[act]
            mine = place // run
            sibling = begin[act] + (mine ^ 1) * run
            stop = np.minimum(sibling + run, begin[act] + size[act])
            has = sibling < stop
            act, place, mine, sibling, stop = act[has], place[has], mine[has], sibling[has], stop[has]
            low, high = sibling.copy(), stop.copy()
            item = order[act]
            todo = np.arange(len(act))
            while len(todo):
                middle = (low[todo] + high[todo]) >> 1
                right = self.before(order[middle], item[todo])
                low[todo] = np.where(right, middle + 1, low[todo])
                high[todo] = np.where(right, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            to = begin[act] + (mine & ~1) * run + place % run + (low - sibling)
            merged = order.copy()
            merged[to] = item
            order = merged
            run *= 2


def repeated(data: np.ndarray, off: np.ndarray, group: np.ndarray, left: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each context and distance of a window's start before the anchor, whether the window occurs in a context of lower rank.

    off bounds the contexts; group, ascending, is the anchor's; left its place in the context.
    """
    n = len(group)
    suffixes = _Suffixes(data, off[:-1] + left, np.diff(off) - left, rank)
    order = suffixes.sort(group)
    i, j = order[:-1], order[1:]
    together = group[i] == group[j]
    lcp = np.zeros(n, dtype=np.int64)  # of each in order with the one before it
    lcp[1:] = np.where(together, suffixes.common(i, j), 0)
    _verify(suffixes, i, j, lcp[1:], together)
    out = np.zeros((n, WIDTH + 1), dtype=bool)
    sorted_rank = np.argsort(rank, kind="stable")
    of = np.full(n, -1)
    begin = suffixes.begin
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    for l in range(WIDTH - 1, -1, -1):
        joined = lcp >= SPAN - l
        run = np.cumsum(~joined)
        linked = joined.copy()
        linked[:-1] |= joined[1:]
        valid = linked[place] & (left >= l) & (left - l < windows)
        items = sorted_rank[valid[sorted_rank]]
        if len(items) < 2:
            continue
        b = begin[items]
        keys = C.mix(C.mix(C.span_hashes(suffixes.prefix, b - l, b)) ^ C.mix(run[place[items]].astype(np.uint64)))
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        reference = items[first[inverse]]
        again = reference != items
        item, ref = items[again], reference[again]
        fresh = of[item] != ref
        if fresh.any():
            x, y = begin[item[fresh]], begin[ref[fresh]]
            same = np.ones(len(x), dtype=bool)
            for step in range(1, l + 1):
                same &= data[x - step] == data[y - step]
            bad = np.flatnonzero(fresh)[~same]
            if len(bad):  # a collision: leave those out
                keep = np.ones(len(item), dtype=bool)
                keep[bad] = False
                item, ref = item[keep], ref[keep]
        of[item] = ref
        out[item, l] = True
    return out


def _verify(s: _Suffixes, i: np.ndarray, j: np.ndarray, lcp: np.ndarray, together: np.ndarray) -> None:
    """Common prefixes of neighbours, compared byte by byte; a wrong one is cut down to what is equal."""
    at = np.flatnonzero(together & (lcp > 0))
    for lo in range(0, len(at), 50_000):
        own = at[lo : lo + 50_000]
        a, b, m = s.begin[i[own]], s.begin[j[own]], lcp[own]
        ok = np.ones(len(own), dtype=bool)
        good = np.zeros(len(own), dtype=np.int64)
        for step in range(int(m.max())):
            live = m > step
            ok &= ~live | (s.data[np.where(live, a + step, 0)] == s.data[np.where(live, b + step, 0)])
            good += ok & live
        lcp[own] = good


def _ranges(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """Removed ranges of the suffixes of whole groups, given in order of their anchors."""
    table = pa.Table.from_batches(rows).combine_chunks()
    h, k, x = (np.asarray(table[c]) for c in ("h", "k", "x"))
    c = table["c"].chunk(0) if table["c"].num_chunks else pa.array([], pa.binary())
    _, offsets, buffer = c.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    data = np.frombuffer(buffer, dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    at, left, windows = unpack(x)
    rank = np.empty(len(h), dtype=np.int64)
    rank[np.lexsort((x, k))] = np.arange(len(h))
    gone = repeated(data, off, h, left, windows, rank)
    edge = np.diff(np.concatenate((np.zeros((len(h), 1), bool), gone), axis=1).astype(np.int8), axis=1)
    i, low = np.nonzero(edge == 1)
    j, high = np.nonzero(edge == -1)
    high = high - 1  # distances low to high of document i
    start, end = at[i] - high, at[i] - low + SPAN
    mark = x[i] >> 46 << 46
    return pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(mark | start), pa.array(end)], ["k", "x", "y"])


def sort_suffixes(rows: DataFrame) -> DataFrame:
    """(k, x, y): the ranges of suffixes (h, k, x, c) that repeat, from rows partitioned and sorted by h."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, SORT_ROWS // 2):
                batch = whole.slice(lo, SORT_ROWS // 2)
                h = np.asarray(C.column(batch, "h"))
                cut = int(np.searchsorted(h, h[-1], "left"))  # the last group may go on
                if held and cut == 0 and np.asarray(C.column(held[-1], "h"))[-1] != h[0]:
                    yield _ranges(held)
                    held, n = [], 0
                if n + cut >= SORT_ROWS and cut:
                    yield _ranges([*held, batch.slice(0, cut)])
                    held, n = [batch.slice(cut)], batch.num_rows - cut
                else:
                    held.append(batch)
                    n += batch.num_rows
        if held:
            yield _ranges(held)

    return rows.mapInArrow(work, "k long, x long, y long")


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """docs with _kl_k, _kl_t and the ranges to remove: _kl_x (start, with the mark of the row's text), _kl_y (end) and _kl_c (SHA-256 that the range must have, or null).

    Contexts of one anchor are compared by hash first: of equal ones all but the
    first go whole, if the bytes are found to be equal. Only anchors with several
    contexts are sorted, by the first of each.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"_kl_k": F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEYS) - F.xxhash64(body).bitwiseAND(F.lit((1 << 61) - 1))), "_kl_t": body})
    scan = rows.select("_kl_k", "_kl_t")

    def step(df: DataFrame, name: str, *read: DataFrame) -> DataFrame:
        """Write df; then drop the tables that only it read, and its shuffles."""
        out = C.written(df, name)
        C.discard(*read)
        C.release_shuffles(spark)
        return out

    again = step(anchors(scan).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-anchors")
    places = step(anchors(scan).join(again.hint("merge"), "h"), "anchor-places", again)
    first = F.min(F.struct("k", "x")).alias("first")
    firsts = step(places.groupBy("h", "g").agg(first, F.count("*").alias("n")).select("h", "g", F.col("first.k").alias("k0"), F.col("first.x").alias("x0"), "n"), "contexts")

    def start(x: str):
        return F.shiftrightunsigned(x, 14).bitwiseAND(F.lit(0xFFFFFFFF)) - F.shiftrightunsigned(x, 7).bitwiseAND(F.lit(127))

    def mark(x: str):
        return F.shiftleft(F.shiftright(x, 46), 46)

    copies = places.join(firsts.filter("n > 1").drop("n").hint("merge"), ["h", "g"]).filter("k > k0 OR k = k0 AND x > x0")
    copies = copies.select("k", (mark("x") + start("x")).alias("x"), (start("x") + F.col("x").bitwiseAND(F.lit(127)) + SPAN).alias("y"), "k0", (mark("x0") + start("x0")).alias("x0"))
    copies = copies.groupBy("k").agg(F.collect_list(F.struct("x", "y", "k0", "x0")).alias("r")).select("k", *[F.col(f"r.{c}").alias(c) for c in ("x", "y", "k0", "x0")])
    copies = step(joined_copies(copies), "copies", places)
    size = F.col("y") - F.col("x").bitwiseAND(F.lit(_PLACE))
    copied = copies.select("k0", "x0", size.alias("n")).distinct().groupBy("k0").agg(F.collect_list(F.struct("x0", "n")).alias("o")).select("k0", F.col("o.x0").alias("_o"), F.col("o.n").alias("_n"))
    several = firsts.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h", (F.col("m") > hot).cast("int").alias("s"))
    listed = firsts.join(several.hint("merge"), "h").groupBy("k0").agg(F.collect_list(F.struct("x0", "h", "s")).alias("a"))
    listed = listed.select("k0", F.col("a.x0").alias("_a"), F.col("a.h").alias("_h"), F.col("a.s").alias("_s")).join(copied.hint("merge"), "k0", "full")
    listed = step(listed, "listed", firsts)
    found = step(contexts(scan.join(listed.hint("merge"), F.col("_kl_k") == F.col("k0")).drop("k0")), "suffixes", listed)
    cold = sort_suffixes(found.filter("kind = 1").select("h", "k", "x", "c").repartition(n, "h").sortWithinPartitions("h"))
    windows = found.filter("kind = 2").select("k", "x", "c")
    first_windows = windows.groupBy("c").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    warm = windows.join(first_windows, "c").filter(F.struct("k", "x") > F.col("first")).select("k", "x", (F.col("x").bitwiseAND(F.lit(_PLACE)) + SPAN).alias("y"))
    ranges = found.filter("kind = 3").select(F.col("k").alias("k0"), F.col("x").alias("x0"), F.col("y").alias("n"), "c").distinct()
    checked = copies.withColumn("n", size).join(ranges.hint("merge"), ["k0", "x0", "n"]).select("k", "x", "y", "c")
    gone = cold.unionByName(warm).withColumn("c", F.lit(None).cast("binary")).unionByName(checked)
    gone = step(gone.groupBy("k").agg(F.collect_list(F.struct("x", "y", "c")).alias("_r")), "removed-ranges", found, copies)
    gone = gone.select("k", *[F.col(f"_r.{c}").alias(f"_kl_{c}") for c in "xyc"])
    return rows.join(gone.hint("merge"), F.col("_kl_k") == F.col("k"), "left").drop("k")


def cut_out(raw: np.ndarray, start: np.ndarray, end: np.ndarray, digests: list[bytes | None]) -> np.ndarray:
    """Whether each byte is in a range; a range whose bytes do not have its digest is left out."""
    step = np.zeros(len(raw) + 1, dtype=np.int64)
    view = memoryview(raw)
    own = np.array([c is None or hashlib.sha256(view[a:b]).digest() == c for a, b, c in zip(start.tolist(), end.tolist(), digests)], dtype=bool)
    np.add.at(step, start[own], 1)
    np.add.at(step, end[own], -1)
    return np.cumsum(step[:-1]) > 0


_DIGEST = T.StructType([T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT, keep_bytes: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes (columns of those names are replaced).

    A null text counts as empty. Rows of null keys come before all others, ordered
    by a hash of their text. Equal rows count as one document; different texts of
    one key are ordered by a 16-bit hash that tells them apart. Keys are taken as
    whole numbers, from -2**62. A table without rows gives none; a text is worked on
    whole, however long, up to 2**32 bytes.
    """
    added = _DIGEST.fields if keep_bytes else _DIGEST.fields[:4]
    names = [x for x in docs.columns if x not in {f.name for f in added}]
    docs = docs.select(*[F.col(f"`{x}`") for x in names])
    rows = removed(docs, text, key, hot)
    out = [x for x in names if x != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, "_kl_t"))
            for lo, hi in C.chunks(off, ANCHOR_BYTES):
                raw, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                marks = _marks(raw, o, C.prefix_hashes(raw))
                part = batch.slice(lo, hi - lo)
                (x, y), doc = _lists(part, ["_kl_x", "_kl_y"], 0, hi - lo)
                own = np.flatnonzero((x >> 46) == marks[doc])
                digests = C.column(part, "_kl_c").flatten().take(pa.array(own)).to_pylist()
                cut = cut_out(raw, o[doc[own]] + (x[own] & _PLACE), o[doc[own]] + y[own], digests)
                edge = cut.copy()
                inner = o[1:-1][o[1:-1] < len(raw)]
                edge[1:] &= ~cut[:-1]
                edge[inner] |= cut[inner]
                bytes_ = [raw[a:b][~cut[a:b]].tobytes() for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
                total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[o])
                cols = [np.diff(o), total(cut), total(edge)]
                more = [pa.array(bytes_, pa.binary())] if keep_bytes else []
                yield pa.RecordBatch.from_arrays(
                    [C.column(part, c) for c in out] + [pa.array(v.astype(np.int64)) for v in cols] + [pa.array([hashlib.sha256(b).hexdigest() for b in bytes_])] + more, [*out, *(f.name for f in added)]
                )

    return rows.mapInArrow(work, T.StructType([docs.schema[x] for x in out] + added))
