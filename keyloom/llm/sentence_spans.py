"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs met in more than one
place are found by one global aggregation and join, and sentences covered by
any occurrence but the first are removed.

A sentence ends at `.`, `!` or `?` (other marks may follow) or at a line break.
One also ends after the word of the smallest hash of each CLAUSE neighbours of a
document, so none is longer than CLAUSE words, and after a word that repeats the
one before it. Equal passages are cut alike but for their first and last CLAUSE - 1
words, so each of 51 words or more holds a whole run. The run that begins at a sentence is
the shortest of RUN sentences and RUN_WORDS words at least; words are compared
in lower case (A-Z), white space is not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

RUN, RUN_WORDS, CLAUSE = 3, 25, 8
_STOP = np.zeros(256, dtype=bool)
_STOP[np.frombuffer(b".!?", dtype=np.uint8)] = True


def _smallest(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The place of the smallest hash, the last of equal ones, of each CLAUSE neighbours of one document."""
    m = len(hashes) - CLAUSE + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least, at = hashes[:m].copy(), np.arange(m)
    for j in range(1, CLAUSE):
        lower = hashes[j : j + m] <= least
        least[lower] = hashes[j : j + m][lower]
        at[lower] = np.flatnonzero(lower) + j
    return at[doc[:m] == doc[CLAUSE - 1 :]]


class Sentences:
    """Sentences of some documents: bounds of each in bytes, and the hashes of the runs that begin at them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = C.LOWER[data]
        start, end, doc = C.tokens(low, off, C.IN_WORD)
        hashes = C.mix(C.span_hashes(C.prefix_hashes(low), start, end))
        n = len(start)
        stop = np.zeros(n, dtype=bool)
        stop[_smallest(hashes, doc)] = True
        for j in range(1, 5):
            at = end - j
            stop |= (at >= start) & _STOP[data[np.maximum(at, 0)]]
        breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
        stop[:-1] |= breaks[start[1:]] > breaks[end[:-1]]
        stop[1:] |= hashes[1:] == hashes[:-1]
        last = np.ones(n, dtype=bool)
        last[:-1] = doc[1:] != doc[:-1]
        stop |= last
        self.end_word = np.flatnonzero(stop) + 1
        self.first_word = np.concatenate(([0], self.end_word[:-1])) if n else self.end_word
        self.doc = doc[self.first_word] if n else doc
        self.start, self.end = start[self.first_word] if n else start, end[self.end_word - 1] if n else end
        self.bounds = np.searchsorted(self.doc, np.arange(len(off)))
        m = len(self.end_word)
        self.to = np.maximum(np.arange(m) + RUN - 1, np.searchsorted(self.end_word, self.first_word + RUN_WORDS))
        inside = self.to < m
        inside[inside] = self.doc[self.to[inside]] == self.doc[inside]
        self.runs = np.flatnonzero(inside)
        a, b = self.first_word[self.runs], self.end_word[self.to[self.runs]]
        self.h, self.g = (C.mix(C.span_hashes(self._prefix(C.mix(hashes + np.uint64(s))), a, b)) for s in (1, 2))
        self.g = self.g >> np.uint64(32)

    @staticmethod
    def _prefix(values: np.ndarray) -> np.ndarray:
        up, _ = C.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def new(self) -> np.ndarray:
        """Whether each run is its document's first of that hash."""
        keys = C.mix(self.h ^ C.mix(self.g + (self.doc[self.runs].astype(np.uint64) << np.uint64(33))))
        _, first = np.unique(keys, return_index=True)
        out = np.zeros(len(self.runs), dtype=bool)
        out[first] = True
        return out


def runs(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(_h, _g, _kl_k, _at): the hash of each document's runs and the sentence at which it first begins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, "_t"))
            keys = C.column(batch, "_kl_k")
            for lo, hi in C.chunks(off):
                s = Sentences(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                own = s.new()
                at = s.runs[own]
                doc = s.doc[at]
                cols = [pa.array(s.h[own].view(np.int64)), pa.array(s.g[own].astype(np.uint32).view(np.int32)), keys.take(pa.array(doc + lo)), pa.array((at - s.bounds[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["_h", "_g", "_kl_k", "_at"])

    rows = docs.select(F.col(key).alias("_kl_k"), F.col(text).alias("_t"))
    return rows.mapInArrow(work, f"_h long, _g int, _kl_k {rows.schema['_kl_k'].dataType.simpleString()}, _at int")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with repeated sentences cut out of text, and n_sentences and n_removed (columns of those names are replaced).

    The first occurrence is that of the smallest key, and in a document the
    earliest. Rows that share a key are taken for one document; rows of a null
    key lose repeats within themselves only. A null text stays null and has no
    sentences; a text of which nothing is left is empty. White space before a
    removed sentence goes with it.
    """
    names = [x for x in docs.columns if x not in ("n_sentences", "n_removed")]
    docs = docs.select(*[F.col(f"`{x}`") for x in names])
    own = runs(docs, text, key)
    first = own.groupBy("_h", "_g").agg(F.min("_kl_k").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    again = own.join(first, ["_h", "_g"]).filter("_kl_k > _first").groupBy("_kl_k").agg(F.sort_array(F.collect_set("_at")).alias("_kl_again"))
    again = C.written(again, "sentence-runs")
    C.release_shuffles(docs.sparkSession)
    rows = docs.join(again.hint("merge"), docs[key] == again["_kl_k"], "left").drop("_kl_k")  # it grows with the corpus: shuffled at any size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = C.column(batch, text)
            data, off = C.text_bytes(column)
            gone = C.column(batch, "_kl_again").to_pylist()
            for lo, hi in C.chunks(off):
                o = off[lo : hi + 1] - off[lo]
                raw = data[off[lo] : off[hi]]
                s = Sentences(raw, o)
                step = np.zeros(len(s.doc) + 1, dtype=np.int64)
                starts = [s.runs[~s.new()]] + [s.bounds[d] + np.array(x, dtype=np.int64) for d, x in enumerate(gone[lo:hi]) if x]
                starts = np.concatenate(starts)
                np.add.at(step, starts, 1)
                np.add.at(step, s.to[starts] + 1, -1)
                cut = np.cumsum(step[:-1]) > 0
                texts = column[lo:hi].to_pylist()
                removed = np.add.reduceat(np.concatenate((cut, [0])).astype(np.int64), s.bounds[:-1]) * (np.diff(s.bounds) > 0)
                for d in np.flatnonzero(removed).tolist():
                    a, b = int(s.bounds[d]), int(s.bounds[d + 1])
                    base, kept, at = int(o[d]), [], int(o[d])
                    for i in np.flatnonzero(cut[a:b]).tolist():
                        before = int(s.end[a + i - 1]) if i else base
                        kept.append(raw[at : max(at, before)].tobytes())
                        at = int(s.end[a + i])
                    kept.append(raw[at : int(o[d + 1])].tobytes())
                    texts[d] = b"".join(kept).decode("utf-8", "replace").lstrip() if cut[a] else b"".join(kept).decode("utf-8", "replace")
                part = batch.slice(lo, hi - lo)
                cols = [pa.array(texts, pa.string()) if x == text else C.column(part, x) for x in names]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(np.diff(s.bounds)), pa.array(removed)], [*names, "n_sentences", "n_removed"])

    schema = T.StructType([docs.schema[x] for x in names] + [T.StructField(x, T.LongType()) for x in ("n_sentences", "n_removed")])
    return rows.mapInArrow(work, schema)
