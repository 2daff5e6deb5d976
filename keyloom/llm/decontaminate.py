"""Benchmark decontamination.

The benchmark's word n-grams are hashed on normalised words and broadcast in
blocks of proven size; documents are scanned in Arrow batches, each hit is
verified on the words themselves, and hit spans or whole documents go.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

#: Words of a window.
WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Benchmark text, in bytes, that is broadcast at once, as at most 11 times as many bytes. A larger benchmark is worked off in blocks of this size.
BLOCK_BYTES = 24 << 20


def _hashed(raw: np.ndarray, off: np.ndarray):
    data = C.LOWER[raw]
    start, end, doc = C.tokens(data, off, C.IN_ALNUM)
    return data, start, end, doc, C.mix(C.span_hashes(C.prefix_hashes(data), start, end))


class Grams:
    """The windows of some benchmark items, in flat arrays: by length, the sorted hashes, and of each window its item and its place in the items' words, which stand in one buffer, a space apart."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.items = [str(item) for item, _ in items]
        words, found, size = bytearray(), {}, 0
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            data, start, end, doc, hashes = _hashed(raw, np.array([0, len(raw)]))
            if not len(start):
                continue
            n = min(window, len(start))
            at, keys = C.run_hashes(hashes, doc, n)
            low = data.tobytes()
            words += b" ".join(low[a:b] for a, b in zip(start.tolist(), end.tolist())) + b" "
            stop = size + np.cumsum(end - start + 1) - 1
            begin = stop - (end - start)
            found.setdefault(n, []).append((keys, np.full(len(at), k, np.int32), begin[at].astype(np.int32), stop[at + n - 1].astype(np.int32)))
            size = len(words)
        self.words = bytes(words)
        self.windows = {}
        for n, parts in found.items():
            keys, item, begin, stop = map(np.concatenate, zip(*parts))
            order = np.lexsort((item, keys))
            keys, item, begin, stop = keys[order], item[order], begin[order], stop[order]
            new = np.ones(len(keys), dtype=bool)  # a window that an item repeats is kept once, unless hashes collide
            new[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]) | ((stop - begin)[1:] != (stop - begin)[:-1])
            same = np.flatnonzero(~new)
            new[same[[self.words[begin[i] : stop[i]] != self.words[begin[i - 1] : stop[i - 1]] for i in same.tolist()]]] = True
            self.windows[n] = keys[new], item[new], begin[new], stop[new]

    def size(self) -> int:
        """Bytes of the arrays."""
        return len(self.words) + sum(x.nbytes for own in self.windows.values() for x in own)

    def scan(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each document: its words, the hit runs of bytes as (start, end, words) and the items found."""
        data, start, end, doc, hashes = _hashed(raw, off)
        n_docs = len(off) - 1
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        items: dict[int, set[str]] = defaultdict(set)
        step = np.zeros(len(start) + 1, dtype=np.int64)
        low = None
        for n, (keys, item, begin, stop) in self.windows.items():
            at, found = C.run_hashes(hashes, doc, n)
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for i in np.flatnonzero(keys[place] == found).tolist():
                low = data.tobytes() if low is None else low
                a, k = int(at[i]), int(place[i])
                own = b" ".join(low[start[j] : end[j]] for j in range(a, a + n))
                hit = False
                while k < len(keys) and keys[k] == found[i]:
                    if self.words[begin[k] : stop[k]] == own:
                        items[int(doc[a])].add(self.items[item[k]])
                        hit = True
                    k += 1
                if hit:
                    step[a] += 1
                    step[a + n] -= 1
        hit = np.cumsum(step[:-1]) > 0
        for d in range(n_docs):
            lo, hi = int(first[d]), int(first[d + 1])
            runs = []
            if d in items:
                inside = np.flatnonzero(np.diff(np.concatenate(([0], hit[lo:hi].astype(np.int8), [0]))))
                runs = [(int(start[lo + a] - off[d]), int(end[lo + b - 1] - off[d]), b - a) for a, b in inside.reshape(-1, 2).tolist()]
            yield hi - lo, runs, sorted(items.get(d, ()))


#: What scanning adds; the names are reserved and must not be columns of the documents.
FOUND = T.StructType(
    [
        T.StructField("_kl_n_words", T.LongType()),
        T.StructField("_kl_runs", T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "end", "words")]))),
        T.StructField("_kl_items", T.ArrayType(T.StringType())),
    ]
)


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[object, str | None]]]:
    own, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        own.append((row.i, row.t))
        size += len((row.t or "").encode()) + 64
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with `_kl_n_words`, `_kl_runs` (byte runs hit by verified windows) and `_kl_items` (items found).

    Null and empty texts have no words and no hits; an empty benchmark hits
    nothing; items without words are ignored; repeated rows are judged alike.
    The benchmark is read by blocks of `block_bytes`; each is broadcast by
    itself, and between blocks the scanned documents are written out, so memory
    stays bounded for any benchmark.
    """
    spark = docs.sparkSession
    names = [x for x in docs.columns if x not in FOUND.names]
    docs = docs.select(*[F.col(f"`{x}`") for x in names])
    found = last = None
    for k, own in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        shared = spark.sparkContext.broadcast(Grams(own, window))
        if found is not None:
            before, last = last, C.written(found, f"scanned-{k}")
            if before is not None:
                C.discard(before)
        found = _scanned(docs if last is None else last, shared, text, names, last is not None)
    return found if found is not None else _scanned(docs, spark.sparkContext.broadcast(Grams([])), text, names)


def _scanned(df: DataFrame, shared, text: str, names: list[str], again: bool = False) -> DataFrame:
    schema = T.StructType([df.schema[x] for x in names] + FOUND.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        kinds = None
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, text))
            for lo, hi in C.chunks(off):
                n_words, runs, items = [], [], []
                for n, r, i in grams.scan(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    n_words.append(n)
                    runs.append(r)
                    items.append(i)
                if again:
                    for k, (r, i) in enumerate(zip(C.column(batch, "_kl_runs")[lo:hi].to_pylist(), C.column(batch, "_kl_items")[lo:hi].to_pylist())):
                        if i:
                            runs[k] = _joined(data[off[lo + k] : off[lo + k + 1]], runs[k] + [(x["start"], x["end"], x["words"]) for x in r])
                            items[k] = sorted({*items[k], *i})
                kinds = kinds or pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "words")]))
                dicts = [[{"start": a, "end": b, "words": w} for a, b, w in r] for r in runs]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [C.column(part, x) for x in names] + [pa.array(n_words, pa.int64()), pa.array(dicts, kinds), pa.array(items, pa.list_(pa.string()))], [*names, *FOUND.names]
                )

    return df.mapInArrow(work, schema)


def _joined(raw: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Unite hit runs of two scans of one text; a run's words are counted anew."""
    start, end, _ = C.tokens(raw, np.array([0, len(raw)]), C.IN_ALNUM)
    hit = np.zeros(len(start) + 2, dtype=np.int8)
    for a, b, _ in runs:
        hit[np.searchsorted(start, a) + 1 : np.searchsorted(end, b) + 2] = 1
    edge = np.flatnonzero(np.diff(hit)).reshape(-1, 2).tolist()
    return [(int(start[a]), int(end[b - 1]), b - a) for a, b in edge]


def _hits():
    return F.aggregate("_kl_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["words"])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated in place of the scan's columns."""
    out = scan(docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated"), benchmark, **options)
    return (
        out.withColumn("n_words", F.col("_kl_n_words"))
        .withColumn("n_hit", _hits())
        .withColumn("n_items", F.size("_kl_items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("_kl_items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
        .drop(*FOUND.names)
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, spans: bool = False, text: str = "text", **options) -> DataFrame:
    """Without contaminated documents, or (spans) with every hit run of bytes cut out of the texts instead."""
    out = scan(docs, benchmark, text=text, **options)
    if not spans:
        hit = _hits()
        return out.filter(~((hit > 0) & (SHARE * hit >= F.col("_kl_n_words")))).drop(*FOUND.names)
    names, schema = docs.columns, docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.column(batch, text).to_pylist()
            for k, runs in enumerate(C.column(batch, "_kl_runs").to_pylist()):
                if runs:
                    raw, at, kept = texts[k].encode(), 0, []
                    for r in runs:
                        kept.append(raw[at : r["start"]])
                        at = r["end"]
                    texts[k] = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == text else C.column(batch, x) for x in names], names)

    return out.mapInArrow(cut, schema)

