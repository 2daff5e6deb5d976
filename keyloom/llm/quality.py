"""Quality rules.

Plain counts of each text reject the obvious cases; the rest is judged by a
logistic regression on hashed word and character n-grams, trained on labelled
quality rows, calibrated on rows held out of the training, and scored in Arrow
batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

#: Labelled rows, at most, that the model is fitted on: the first by a seeded hash of their id.
SAMPLE_ROWS = 4000
#: Feature entries that the fit works on at once.
FIT_ENTRIES = 1 << 20
#: Buckets of each of the two feature kinds.
BUCKETS = 1 << 16
#: Bytes of a character n-gram and words of a word n-gram, the longest.
CHARS, WORDS = 4, 2
MIN_WORDS = 50
#: A document is kept if its calibrated probability of good quality is this at least.
THRESHOLD = 0.2

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    n_docs = len(off) - 1
    start, end, doc = C.tokens(data, off, C.IN_WORD)
    prefix = C.prefix_hashes(data)
    hashes = C.mix(C.span_hashes(prefix, start, end))
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_doc(C.IN_WORD[data] & _STARTS_CHAR[data], off)
    out["n_symbols"] = _per_doc(_SYMBOL[data], off)

    at, runs = C.run_hashes(hashes, doc, 3)
    own = _repeated(C.mix(runs ^ C.mix(doc[at].astype(np.uint64) + np.uint64(1))))
    step = np.zeros(len(start) + 1, dtype=np.int64)
    np.add.at(step, at[own], 1)
    np.add.at(step, at[own] + 3, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(step[:-1]) > 0, first)

    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    bound = np.concatenate((line_start[1:], [len(data)])) if len(line_start) else line_start
    line_end = bound - (data[bound - 1] == 0x0A) if len(bound) else bound
    line_doc = np.searchsorted(off, line_start, "right") - 1
    words_before = np.searchsorted(start, np.concatenate((line_start, bound[-1:])))
    full = np.diff(words_before) > 0 if len(line_start) else np.zeros(0, bool)
    keys = C.mix(C.mix(C.span_hashes(prefix, line_start, line_end) + (line_end - line_start).astype(np.uint64)) ^ C.mix(line_doc.astype(np.uint64) + np.uint64(1)))[full]
    _, kept = np.unique(keys, return_index=True)
    dup = np.ones(len(keys), dtype=np.int64)
    dup[kept] = 0
    out["n_dup_lines"] = np.bincount(line_doc[full], weights=dup, minlength=n_docs).astype(np.int64)
    return out | {"_starts": start, "_hashes": hashes, "_doc": doc, "_first": first}


def features(data: np.ndarray, off: np.ndarray, base: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For word and character n-grams: (bucket, document bounds)."""
    hashes, doc = base["_hashes"], base["_doc"]
    at, pairs = C.run_hashes(hashes, doc, WORDS)
    order = np.argsort(np.concatenate((doc, doc[at])), kind="stable")
    own = np.concatenate((hashes, pairs))[order]
    counts = np.bincount(doc, minlength=len(off) - 1) + np.bincount(doc[at], minlength=len(off) - 1)
    yield (own >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), np.concatenate(([0], np.cumsum(counts)))
    n = len(data) - CHARS + 1
    if n <= 0:
        yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        return
    gram = np.zeros(n, dtype=np.uint32)
    for j in range(CHARS):
        gram = (gram << np.uint32(8)) | data[j : j + n]
    gram *= np.uint32(2654435769)
    bucket = (gram >> np.uint32(16)).astype(np.int64)
    whole = np.ones(n, dtype=bool)  # not across documents
    for j in range(1, CHARS):
        cut = off[1:-1] - j
        whole[cut[(cut >= 0) & (cut < n)]] = False
    bounds = np.concatenate(([0], np.cumsum(whole)))[np.minimum(off, n)]
    yield bucket[whole], bounds


class Model:
    """Linear weights on mean feature counts, and the two numbers of its calibration."""

    def __init__(self, weights: list[np.ndarray], bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def raw(self, data: np.ndarray, off: np.ndarray, base: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(off) - 1, self.bias)
        for w, (bucket, bounds) in zip(self.weights, features(data, off, base)):
            out += _per_doc(w[bucket], bounds) / np.maximum(1, np.diff(bounds))
        return out

    def probability(self, data: np.ndarray, off: np.ndarray, base: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(data, off, base) + self.shift, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(scale, shift) by Newton's method, slightly regularised."""
    p = np.zeros(2)
    design = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -35, 35)))
        g = design.T @ (weight * (q - y)) + 1e-3 * p
        h = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def fit(rows: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]], rounds: int = 80, l2: float = 3e-6) -> Model:
    """Fit on (label, sparse mean features of both kinds), which it uses up; a fourth of the rows calibrates. One label only gives a constant model."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    if len(rows) < 8 or y.min() == y.max():
        return Model([np.zeros(BUCKETS)] * 2, 0.0, 0.0, 0.0 if not len(rows) else (3.0 if y.mean() > 0.5 else -3.0))
    n = len(rows)
    hold = np.arange(n) % 4 == 3
    bounds = np.concatenate(([0], np.cumsum([len(r[1][0][0]) + len(r[1][1][0]) for r in rows])))
    index = np.concatenate([np.concatenate((b0, b1 + BUCKETS)) for _, ((b0, _), (b1, _)) in rows])
    value = np.concatenate([np.concatenate((v0, v1)) for _, ((_, v0), (_, v1)) in rows])
    rows.clear()  # the arrays hold all that is needed
    parts = list(C.chunks(bounds, FIT_ENTRIES))
    train = ~hold
    share = np.where(y == 1, train.sum() / (2 * max(1, y[train].sum())), train.sum() / (2 * max(1, (1 - y)[train].sum()))) * train
    w, bias, seen, bias_seen = np.zeros(2 * BUCKETS), 0.0, np.full(2 * BUCKETS, 1e-12), 1e-12

    def scores() -> np.ndarray:
        out = [_per_doc(w[index[bounds[lo] : bounds[hi]]] * value[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]) for lo, hi in parts]
        return np.concatenate(out) + bias

    for _ in range(rounds):
        g = share * (1 / (1 + np.exp(-np.clip(scores(), -35, 35))) - y) / train.sum()
        grad = l2 * w * 1e-2
        for lo, hi in parts:
            own = slice(bounds[lo], bounds[hi])
            grad += np.bincount(index[own], weights=value[own] * np.repeat(g[lo:hi], np.diff(bounds[lo : hi + 1])), minlength=2 * BUCKETS)
        seen += grad * grad
        bias_seen += g.sum() ** 2
        w -= 2.0 * grad / np.sqrt(seen)
        bias -= 0.1 * g.sum() / np.sqrt(bias_seen)
    z = scores()
    scale, shift = _logistic(z[hold], y[hold], np.ones(hold.sum()))
    return Model([w[:BUCKETS], w[BUCKETS:]], bias, scale, shift)


def sparse(data: np.ndarray, off: np.ndarray, base: dict[str, np.ndarray]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per document, both kinds' (buckets, mean counts)."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(off) - 1)]
    for bucket, bounds in features(data, off, base):
        for d in range(len(off) - 1):
            own, n = np.unique(bucket[bounds[d] : bounds[d + 1]], return_counts=True)
            out[d].append((own.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled documents, half of each label as far as there are; their features alone reach the driver.

    Rows with a null label or text are passed over. Repeated label rows count once each.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit(17))
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    ids = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).withColumn("_o", F.xxhash64(F.col("_k").cast("string"), F.lit(17))).orderBy("_o", "_k").limit(sample_rows // 2)
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(ids.select("_k", "_y")), "_k")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, "_t"))
            for lo, hi in C.chunks(off):
                own, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                found = sparse(own, o, base_counts(own, o))
                cols = [pa.array([f[i][j].tobytes() for f in found], pa.binary()) for i in (0, 1) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([C.column(batch, "_k")[lo:hi], C.column(batch, "_y")[lo:hi], *cols], ["_k", "_y", "a", "b", "c", "d"])

    kind = rows.schema["_k"].dataType
    schema = T.StructType([T.StructField("_k", kind), T.StructField("_y", T.IntegerType())] + [T.StructField(x, T.BinaryType()) for x in "abcd"])
    got = rows.mapInArrow(work, schema).withColumn("_o", F.xxhash64(F.col("_k").cast("string"), F.lit(17))).orderBy("_o", "_k").drop("_o")
    fetched = [(r._y, [(np.frombuffer(r.a, np.int32), np.frombuffer(r.b, np.float32)), (np.frombuffer(r.c, np.int32), np.frombuffer(r.d, np.float32))]) for r in got.toLocalIterator()]
    model = fit(fetched)
    C.trim()
    return model


SCORED = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def judge(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, quality_score (calibrated probability) and kept.

    A null text counts as empty: no words, so it fails the base rules. Columns
    of docs that are named like the added ones are replaced.
    """
    names = [x for x in docs.columns if x not in SCORED.names]
    docs = docs.select(*[F.col(f"`{x}`") for x in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = shared.value
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, text))
            for lo, hi in C.chunks(off):
                own, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                base = base_counts(own, o)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                p = own_model.probability(own, o, base)
                cols = [pa.array(base[x], pa.int64()) for x in SCORED.names[:5]]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([C.column(part, x) for x in names] + [*cols, pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [*names, *SCORED.names])

    return docs.mapInArrow(work, T.StructType(docs.schema.fields + SCORED.fields))
