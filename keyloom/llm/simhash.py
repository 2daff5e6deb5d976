"""SimHash near-duplicates.

A fingerprint holds, for each bit, whether it is set in over half of the hashes
of the text's shingles. Equal fingerprints are one node. Nodes meet in buckets.
In a bucket a pivot table (the Hamming distances to many reference fingerprints)
discards pairs by their largest coordinate difference, which can't exceed the
distance of the pair; survivors are verified bit by bit. Buckets yield the links
of a spanning forest, never all pairs, and components are found by star
contraction.

Two ways lead to buckets. classes() links fingerprints within a few bits: of k + 1
disjoint blocks of bits, two fingerprints that differ in at most k bits share
one. near_duplicates() links similar sets of shingles, whose fingerprints differ
in too many bits for that, so their buckets are of equal smallest shingles.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C

_GAP = re.compile(rb"[\x20\x09-\x0D]")

RADIUS, SHINGLE, SEED = 2, 3, 42
#: near_duplicates(): words of a shingle, least similarity, 64-bit words of the fingerprint, keys of a text, shingles that make up a key.
WORDS, SIMILARITY, WIDE, KEYS, OF_KEY = 5, 0.8, 4, 12, 2
#: Fingerprints estimate a similarity with an error of some 0.03. Pairs within the distance expected at similarity - SLACK are verified
#: on their shingles.
SLACK = 0.15
#: Reference fingerprints of the pivot table.
PIVOTS = 32
#: A larger bucket is dealt out again: by blocks of the remaining bits, or by further keys; a larger family is worked on in parts.
BUCKET_ROWS = 2000
#: Pairs that are compared at once, and rows of a bucket whose pairs are enumerated together with those of others.
STRIP_PAIRS, SMALL = 1 << 20, 64
#: Shingles, and bytes of text, that a fingerprint takes in at once.
SLICE, SLICE_BYTES = 1 << 16, 1 << 20


def _ones(hashes: np.ndarray) -> np.ndarray:
    """Of each of the 64 bits, highest first, how many hashes have it set."""
    out = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), SLICE):
        out += np.unpackbits(hashes[lo : lo + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return out


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part, cut at white space."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        end = next((m.end() for m in _GAP.finditer(text, at + SLICE_BYTES)), len(text))
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of lower-cased (A-Z) white-space words; 0 without words."""
    digest = xxhash.xxh64_intdigest
    ones, n, held = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_slices(text):
        words = held + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
            ones += _ones(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64))
            n += len(words) - shingle + 1
            words = words[len(words) - shingle + 1 :]
        held = words
    if not n:
        return digest(b" ".join(held), seed) if held else 0
    return _majority(ones, n)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed 64-bit integer; a null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, "_t"))
            raw = memoryview(data)
            fps = [fingerprint(bytes(raw[a:b]), shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([C.column(batch, "_k"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["_k", "fp"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.mapInArrow(work, f"_k {rows.schema['_k'].dataType.simpleString()}, fp long").withColumnRenamed("_k", key)


def references(fps: np.ndarray, radius: int) -> np.ndarray:
    """PIVOTS reference fingerprints: random ones tell near fingerprints apart. Within a wide radius only references among the fingerprints themselves do."""
    if radius < 4 * fps.shape[1]:
        return np.random.default_rng(7).integers(0, 2**64, (PIVOTS, fps.shape[1]), dtype=np.uint64)
    return fps[np.unique(np.linspace(0, len(fps) - 1, PIVOTS).astype(np.int64))]


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint (a row of 64-bit words) to each reference."""
    out = np.zeros((len(fps), len(pivots)), dtype=np.int16)
    for w in range(fps.shape[1]):
        out += np.bitwise_count(fps[:, w, None] ^ pivots[None, :, w])
    return out


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that no coordinate of the pivot table discards: no pair lies nearer than its largest coordinate difference."""
    for c in range(table.shape[1]):
        near = np.abs(table[i, c] - table[j, c]) <= radius
        i, j = i[near], j[near]
    return i, j


def distances(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), dtype=np.int64)
    for w in range(fps.shape[1]):
        out += np.bitwise_count(fps[i, w] ^ fps[j, w])
    return out


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label with the components of each pair united; the smaller label wins."""
    while len(i):
        a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        low = np.arange(len(label))
        np.minimum.at(low, b, a)
        while True:
            deeper = low[low]
            if (deeper == low).all():
                break
            low = deeper
        label = low[label]
        own = label[i] != label[j]
        i, j = i[own], j[own]
    return label


class _Bucket:
    """A bucket's fingerprints, in order of the first pivot coordinate, and the component of each.

    Rows are taken in strips and compared with those that are not in their
    component yet, so a bucket of copies of one text costs one strip.
    """

    def __init__(self, fps: np.ndarray, radius: int, sizes: np.ndarray | None = None, least: float = 0.0, roots: np.ndarray | None = None):
        self.n, self.radius = len(fps), radius
        table = pivot_table(fps, references(fps, radius))
        self.order = np.argsort(table[:, 0], kind="stable")
        self.fps, self.table, self.least = fps[self.order], table[self.order], least
        self.sizes = sizes[self.order] if sizes is not None else None
        self.label = np.arange(self.n) if roots is None else np.unique(roots, return_inverse=True)[1][self.order]

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Strips of pairs (i, j, distance) within the radius whose components differ."""
        hi = 0
        while hi < self.n:
            lo, hi = hi, min(self.n, hi + max(1, STRIP_PAIRS // self.n))
            # along the first coordinate, partners lie in a narrow range
            end = int(np.searchsorted(self.table[:, 0], self.table[hi - 1, 0] + self.radius, "right"))
            main = np.bincount(self.label[lo:end]).argmax()
            rows, cols = np.arange(lo, hi), np.arange(lo, end)
            beyond, away = cols[hi - lo :], self.label[rows] != main
            for x, y in ((rows[~away], beyond[self.label[beyond] != main]), (rows[away], cols)):
                if len(x) and len(y):
                    i, j = (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
                    yield self._verified(i, j, (j >= hi) | (self.label[j] == main) | (i < j))

    def _verified(self, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own &= self.label[i] != self.label[j]
        i, j = survivors(self.table, i[own], j[own], self.radius)
        distance = distances(self.fps, i, j)
        near = distance <= self.radius
        if self.sizes is not None:
            near &= np.minimum(self.sizes[i], self.sizes[j]) >= self.least * np.maximum(self.sizes[i], self.sizes[j])
        return i[near], j[near], distance[near]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.label = united(self.label, i, j)

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of all but the roots, as places in the bucket as it was given."""
        member = np.flatnonzero(self.label != np.arange(self.n))
        return self.order[member], self.order[self.label[member]]


def bucket_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) indices of a bucket's fingerprints (rows of 64-bit words) that link them into their components."""
    bucket = _Bucket(fps, radius)
    for i, j, _ in bucket.near():
        bucket.join(i, j)
    return bucket.roots()


def _pairs(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of the same small bucket, about STRIP_PAIRS at once."""
    for n in np.unique(size).tolist():
        x, y = np.triu_indices(n, 1)
        own = begin[size == n]
        step = max(1, STRIP_PAIRS // max(1, len(x)))
        for lo in range(0, len(own), step):
            at = own[lo : lo + step, None]
            yield (at + x).ravel(), (at + y).ravel()


def links_of_buckets(fps: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) indices that link each bucket's fingerprints, rows bounds[k] to bounds[k + 1], into their components."""
    begin, size = bounds[:-1], np.diff(bounds)
    small = (size > 1) & (size <= SMALL)
    label = np.arange(len(fps))
    if small.any():
        table = pivot_table(fps, references(fps, radius))
        for i, j in _pairs(begin[small], size[small]):
            i, j = survivors(table, i, j, radius)
            near = distances(fps, i, j) <= radius
            label = united(label, i[near], j[near])
    member = np.flatnonzero(label != np.arange(len(fps)))
    out = [(member, label[member])]
    for k in np.flatnonzero(size > SMALL).tolist():
        member, root = bucket_links(fps[bounds[k] : bounds[k + 1]], radius)
        out.append((member + bounds[k], root + bounds[k]))
    return tuple(map(np.concatenate, zip(*out)))


class Shared:
    """How many shingles texts share, by the texts that each shingle is in."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        self.columns = np.split(column, np.cumsum(self.size)[:-1])
        order = np.argsort(column, kind="stable")
        self.member = np.repeat(np.arange(len(sets)), self.size)[order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(column))))

    def similarity(self, i: int, others: np.ndarray) -> np.ndarray:
        """Jaccard similarity of text i to others."""
        begin, n = self.begin[self.columns[i]], self.begin[self.columns[i] + 1] - self.begin[self.columns[i]]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(self.member[at], minlength=len(self.size))[others]
        return common / (self.size[i] + self.size[others] - common)


def similar_links(fps: np.ndarray, radius: int, sets: list[np.ndarray], similarity: float, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of a spanning forest of the texts whose sets are similar and whose roots differ; pairs that pivots or fingerprints discard are not looked at."""
    shared = Shared(sets)
    bucket = _Bucket(fps, radius, shared.size, similarity, roots)
    out: list[tuple[int, int]] = []
    for i, j, _ in bucket.near():
        if len(np.unique(i)) > len(np.unique(j)):
            i, j = j, i
        order = np.argsort(i, kind="stable")
        rows, first = np.unique(i[order], return_index=True)
        for x, own in zip(rows.tolist(), np.split(j[order], first[1:])):
            own = own[bucket.label[own] != bucket.label[x]]
            if len(own):
                own = own[shared.similarity(bucket.order[x], bucket.order[own]) >= similarity]
                own = own[np.unique(bucket.label[own], return_index=True)[1]]
                out.extend((x, y) for y in own.tolist())
                bucket.join(np.full(len(own), x), own)
    found = np.array(out, dtype=np.int64).reshape(-1, 2)
    return bucket.order[found[:, 0]], bucket.order[found[:, 1]]


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows equal in names, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(C.column(batch, x)) for x in names])
        if held and (keys[:, 0] != before).any():
            yield pa.Table.from_batches(held)
            held = []
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cut):  # the last group may go on
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))])
            held = [batch.slice(int(cut[-1]))]
        else:
            held.append(batch)
        before = keys[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, names: list[str]) -> np.ndarray:
    keys = np.stack([np.asarray(table[x]) for x in names])
    return np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))


def _blocks(bits: list[int], k: int) -> list[list[int]]:
    """The bits in k + 1 blocks of nearly one size."""
    return [list(map(int, b)) for b in np.array_split(np.array(bits), k + 1)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - 2**64 if m >= 2**63 else m


def links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) pairs of fingerprints, both of one component: enough to connect all that lie within radius. nodes: distinct `fp`."""
    todo = [(block, [x for x in range(64) if x not in block]) for block in _blocks(list(range(64)), radius)]
    rows = nodes.select("fp", F.explode(F.array([F.struct(F.lit(n).alias("band"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("block")) for n, (b, _) in enumerate(todo)])).alias("x")).select("fp", "x.band", F.col("x.block").alias("key"), F.lit(0).cast("long").alias("key2"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n"))
    large = C.written(sizes.filter(F.col("n") > bucket_rows).select("band", "key"), "large-buckets")
    small = rows
    if not large.isEmpty():
        small = rows.join(large.hint("merge"), ["band", "key"], "left_anti")
        again = rows.join(large.hint("merge"), ["band", "key"], "left_semi")
        # within a bucket the block is equal, so of radius + 1 blocks of the other bits one is equal too
        second = []
        for n, (_, rest) in enumerate(todo):
            for m, block in enumerate(_blocks(rest, radius)):
                second.append(F.when(F.col("band") == n, F.struct(F.lit(100 * (n + 1) + m).alias("band"), F.col("fp").bitwiseAND(F.lit(_mask(block))).alias("key2"))))
        deeper = again.select("fp", "key", F.explode(F.array_compact(F.array(*second))).alias("x")).select("fp", F.col("x.band").alias("band"), "key", F.col("x.key2").alias("key2"))
        small = small.unionByName(deeper)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["band", "key", "key2"]
        for table in whole_groups(batches, names):
            fps = np.asarray(table["fp"]).view(np.uint64)
            member, root = links_of_buckets(fps[:, None], group_bounds(table, names), radius)
            own = fps[member] != fps[root]
            yield pa.RecordBatch.from_arrays([pa.array(fps[x[own]].view(np.int64)) for x in (member, root)], ["a", "b"])

    found = small.repartition("band", "key", "key2").sortWithinPartitions("band", "key", "key2").select("fp", "band", "key", "key2")
    return found.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge, as a written table: root is the smallest node of its component.

    Alternates large-star and small-star steps; each is one aggregation to the
    smallest neighbour and one join, and the edges are written between rounds.
    Stops when a round changes nothing. As everywhere here, both sides of a join are
    shuffled, at any size: a broadcast would collect links on the driver.
    """
    edges = C.written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least.hint("merge"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        last, edges = edges, C.written(small, "edges")
        C.discard(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    out = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    out = C.written(out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    C.discard(edges)
    return out


def _labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id): the smallest `least` of the node's component.

    The ids are written before they are joined, so that Spark can split the join
    where one component holds many nodes; nodes without a link are not joined.
    """
    linked = nodes.join(roots.hint("merge"), "node")
    ids = C.written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return linked.join(ids.hint("merge"), "root").select("node", "component_id").unionByName(nodes.join(roots.hint("merge"), "node", "left_anti").select("node", F.col("least").alias("component_id")))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links of at most radius bits.

    Null and empty texts have fingerprint 0 and are linked like any other; rows
    with a null key take part, but give no component its id; repeated rows stay.
    """
    fps = C.written(fingerprints(docs, text, key, shingle), "fingerprints")
    nodes = C.written(fps.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(links(nodes, radius))
    label = C.written(_labelled(nodes.select(F.col("fp").alias("node"), "least"), roots), "labels").withColumnRenamed("node", "fp")
    C.discard(nodes, roots)
    return fps.join(label.hint("merge"), "fp").select(key, "fp", "component_id")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits and component_id."""
    return classes(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def expected_distance(similarity: float, bits: int) -> int:
    """Bits in which SimHash fingerprints of two sets of that Jaccard similarity differ, rounded: they are at an angle whose cosine is 2j / (1 + j)."""
    return round(math.acos(2 * similarity / (1 + similarity)) / math.pi * bits)


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text, a hash of its normalised words and its distinct shingles, as hashes; a text of fewer words is one shingle, one without words has none."""
    data, off = C.text_bytes(texts)
    for lo, hi, hashes, doc in C.word_hashes(data, off, C.IN_WORD):
        first = np.searchsorted(doc, np.arange(lo, hi + 1))
        at, grams = C.run_hashes(hashes, doc, shingle)
        bounds = np.searchsorted(at, first)
        for d in range(hi - lo):
            words = hashes[first[d] : first[d + 1]]
            node = xxhash.xxh64_intdigest(words.tobytes()) if len(words) else 0
            if len(words) >= shingle:
                yield node, np.unique(grams[bounds[d] : bounds[d + 1]])
            else:
                yield node, np.array([node] if len(words) else [], dtype=np.uint64)


def content_keys(grams: np.ndarray, bounds: np.ndarray, keys: int = KEYS, of_key: int = OF_KEY) -> np.ndarray:
    """Keys of each set of shingles grams[bounds[k]:bounds[k + 1]], none empty; a key is of the smallest shingles in of_key orders.

    Sets of similarity s share a key with a probability of 1 - (1 - s ** of_key) ** keys.
    """
    odd, salt = np.random.default_rng(2024).integers(0, 2**64, (2, keys * of_key), dtype=np.uint64)
    out = np.repeat(np.arange(1, keys + 1, dtype=np.uint64)[None], len(bounds) - 1, axis=0)
    for k in range(keys * of_key):
        least = np.minimum.reduceat((grams ^ salt[k]) * (odd[k] | np.uint64(1)), bounds[:-1])
        out[:, k // of_key] = C.mix(out[:, k // of_key] * np.uint64(0x9E3779B97F4A7C15) ^ least)
    return out


def wide_fingerprints(docs: DataFrame, text: str, key: str, shingle: int, words: int = WIDE) -> DataFrame:
    """(_k, _t, node, size, f0, f1, ..., keys): node is a hash of the normalised words, size the number of distinct shingles; see content_keys()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in C.chunks(C.text_bytes(C.column(whole, "_t"))[1]):
                batch, n = whole.slice(lo, hi - lo), hi - lo
                node, size, fps = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros((n, words), np.uint64)
                keys, sets = np.zeros((n, KEYS), np.uint64), []
                for d, (own, grams) in enumerate(_sets(C.column(batch, "_t"), shingle)):
                    node[d], size[d] = own, len(grams)
                    if len(grams):
                        sets.append(grams)
                        for w in range(words):
                            fps[d, w] = _majority(_ones(C.mix(grams + np.uint64(w * 0x9E3779B9 + 1))), len(grams))
                if sets:
                    keys[size > 0] = content_keys(np.concatenate(sets), np.concatenate(([0], np.cumsum(size[size > 0], dtype=np.int64))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * KEYS), pa.array(keys.ravel().view(np.int64)))
                cols = [pa.array(node.view(np.int64)), pa.array(size), *(pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(words)), lists]
                yield pa.RecordBatch.from_arrays([C.column(batch, "_k"), C.column(batch, "_t"), *cols], ["_k", "_t", "node", "size", *(f"f{w}" for w in range(words)), "keys"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.mapInArrow(work, f"_k {rows.schema['_k'].dataType.simpleString()}, _t string, node long, size int, " + ", ".join(f"f{w} long" for w in range(words)) + ", keys array<long>")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = WORDS, similarity: float = SIMILARITY, words: int = WIDE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, component_id) for documents whose sets of word shingles are similar: component_id is the smallest key reachable.

    Sets of a similarity of 0.8 differ in some 15 % of their fingerprints' bits,
    too many for blocks of 64 bits, and random choices of bits would make buckets
    that grow with the corpus. So buckets are of equal content keys, of which a
    pair at the least similarity shares one with a probability of 0.999995; a key
    whose bucket holds the same texts as another's is passed over. A key that more
    than bucket_rows texts share is parted by the further keys that they share.

    Fingerprints within the radius, by the pivot table and bit by bit, put the
    texts of a bucket into one family. Each text is then sent once, to the others
    of its family, and pairs within the radius are verified on the shingles; only
    links of a spanning forest leave the task. A family of more than bucket_rows
    texts is worked on in parts, and what these leave apart by pairs of parts, but
    for pairs within its largest component.

    Texts of the same words are one node; texts without words are one as well.
    Rows of null keys and repeated rows take part like any other; a component of
    null keys alone has a null id.
    """
    made: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(C.written(df, name))
        return made[-1]

    names = [f"f{w}" for w in range(words)]
    fps = written(wide_fingerprints(docs, text, key, shingle, words), "fingerprints")
    nodes = written(fps.groupBy("node").agg(F.min("_k").alias("least"), *(F.first(c).alias(c) for c in ("size", "keys", *names))), "nodes")
    radius = expected_distance(similarity - SLACK, 64 * words)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def several(keyed: DataFrame) -> DataFrame:
        """(key, n) of keys that n > 1 nodes share; of keys that the same nodes share, one."""
        mark = [F.bit_xor(F.xxhash64(F.lit(s), F.col("node"))).alias(f"m{s}") for s in (1, 2)]
        return keyed.groupBy("key").agg(F.count("*").alias("n"), *mark).filter("n > 1").groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key", "n")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"]):
            own = np.stack([np.asarray(table[f]) for f in names], axis=1).view(np.uint64)
            member, root = links_of_buckets(own, group_bounds(table, ["key"]), radius)
            node = np.asarray(table["node"])
            yield pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[root])], ["a", "b"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["family", "x", "y"]):
            bounds = group_bounds(table, ["family", "x", "y"])
            node, root = np.asarray(table["node"]), np.asarray(table["root"])
            own = np.stack([np.asarray(table[f]) for f in names], axis=1).view(np.uint64)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo > 1:
                    sets = [grams for _, grams in _sets(table["_t"].slice(lo, hi - lo).combine_chunks(), shingle)]
                    i, j = similar_links(own[lo:hi], radius, sets, similarity, root[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(node[lo + i]), pa.array(node[lo + j])], ["a", "b"])

    def links_of(rows: DataFrame) -> DataFrame:
        """The verified links of rows (family, x, y, node, root), with their texts and fingerprints."""
        dealt = rows.join(texts.hint("merge"), "node").select("family", "x", "y", "node", "root", "_t", *names)
        return written(dealt.repartition(parts, "family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(verified, "a long, b long"), "verified")

    keyed = nodes.filter("size > 0").select("node", F.explode("keys").alias("key"))
    rows = written(keyed.join(several(keyed).hint("merge"), "key"), "shared-keys")
    large = F.col("n") > bucket_rows
    again = rows.filter(large).join(nodes.select("node", "keys").hint("merge"), "node").select("node", "key", F.explode("keys").alias("other")).filter("key <> other")
    again = again.select("node", F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key")).distinct()
    rows = written(rows.filter(~large).unionByName(again.join(several(again).hint("merge"), "key")), "shared-keys")
    small = rows.filter(~large).join(nodes.select("node", *names).hint("merge"), "node").select("key", "node", *names)
    near = small.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(forest, "a long, b long")
    # what shares even two keys with more than bucket_rows texts is one family at once
    first = rows.filter(large).groupBy("key").agg(F.min("node").alias("b"))
    families = components(near.unionByName(rows.filter(large).join(first.hint("merge"), "key").select(F.col("node").alias("a"), "b")))
    made.append(families)
    families = families.select("node", F.col("root").alias("family"))
    sizes = written(families.groupBy("family").agg(F.count("*").alias("n")), "family-sizes")
    # the texts that may have to be verified, one of each node
    live = families.select("node").join(nodes.select("node", "least", *names).hint("merge"), "node")
    texts = fps.select("node", "_k", "_t").join(live.hint("merge"), "node").filter(F.col("_k").eqNullSafe(F.col("least")))
    texts = written(texts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("_t", *names))), "texts")

    C.release_shuffles(docs.sparkSession)
    dealt = written(families.join(sizes.hint("merge"), "family").withColumn("x", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / bucket_rows))), "dealt")
    links = links_of(dealt.select("family", "x", F.lit(0).cast("long").alias("y"), "node", F.col("node").alias("root")))
    roots = components(links)
    made.append(roots)
    left = written(_pairs_of_parts(dealt.filter(large), roots, bucket_rows), "pairs-of-parts")
    if not left.isEmpty():
        roots = components(links.unionByName(links_of(left)))
        made.append(roots)
    label = C.written(_labelled(nodes.select("node", "least"), roots), "labels")
    C.discard(*made[1:])
    return fps.select("_k", "node").join(label.hint("merge"), "node").select(F.col("_k").alias(key), "component_id")


def _pairs_of_parts(families: DataFrame, roots: DataFrame, bucket_rows: int) -> DataFrame:
    """(family, x, y, node, root): large families that have several components, by pairs of parts of which one at least is not of its largest."""
    own = families.select("family", "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = own.groupBy("family", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("inner"), F.sum("n").alias("n")).filter("n > inner")
    own = own.join(main.hint("merge"), "family").withColumn("away", F.col("root") != F.col("main"))
    outer, inner = F.ceil((F.col("n") - F.col("inner")) / bucket_rows), F.ceil(F.col("inner") / bucket_rows)
    part = F.when(F.col("away"), F.pmod(F.xxhash64("node"), outer)).otherwise(outer + F.pmod(F.xxhash64("node"), inner))
    own = own.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("away"), outer + inner - 1).otherwise(outer - 1))))
    return own.select("family", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"), "node", "root")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without those that are near-duplicates of a document of a smaller key. Rows of the key that stays stay; so do rows of a null key."""
    found = C.written(near_duplicates(docs, text, key, **options).filter(F.col(key) > F.col("component_id")).select(F.col(key).alias("_gone")).distinct(), "duplicates")
    return docs.join(found.hint("merge"), docs[key] == found["_gone"], "left_anti")
