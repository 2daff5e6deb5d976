"""Toxicity by class-conditional Kneser-Ney models.

A text is a sequence of words, and a word one of pieces: PIECE bytes each, the
last of fewer, so that a shorter piece ends the word. Two bigram models of pieces
are learnt, from toxic and from ordinary documents. The context of a word's first
piece is the first piece of the word before it, that of a later piece the word's
beginning. Both are interpolated Kneser-Ney models:

    P(w | v) = max(N(v w) - D, 0) / N(v) + g(v) P(w)
    P(w) = max(K(w) - E, 0) / K + l S(w)

N counts occurrences and K(w) the contexts that w was met in, in the class; g and
l are the masses that the discounts set free. S is what both classes share: the
contexts that w was met in, in either, with one more for each piece and for what
is unknown. Discounts are in proportion to the class, so what is rare is left to
the shared counts in both alike, and cancels out. Rows whose counts are within
the discounts are thus not part of the model, and nothing is lost with them.

Few words of a toxic text are toxic: its words are drawn from the toxic model
with a probability of SHARE, else from the ordinary one. The score compares the
log-likelihoods of this and of the ordinary model, per word, and is calibrated on
labelled rows that the counts have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import common as C
from .quality import _logistic

#: Bytes of a piece.
PIECE = 4
#: Occurrences, and contexts, discounted in the smaller class; in the larger, in proportion.
DISCOUNT = 4.0
#: Share of a toxic text's words that the toxic model is taken to write.
SHARE = 0.003
#: Difference per word at which its scale turns from linear to logarithmic.
UNIT = 1e-4
#: Labelled rows, at most, on which the score is calibrated: train(calibration_rows=...).
CALIBRATION_ROWS = 20_000
#: Rows of the model that are broadcast at once, 24 bytes each; a larger model scores block by block.
BLOCK_ROWS = 2_000_000
FOLDS = 5
_START = 1


def fold(key: str | Column) -> Column:
    """0 to 4: 0 is held out, 1 calibrates, the others are counted."""
    return F.pmod(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")), F.lit(FOLDS))


class Pieces:
    """The pieces of some documents: hashes of each and of its context, its word, the word's document and the hash of the word's first piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = C.LOWER[data]
        start, end, self.doc = C.tokens(low, off, C.IN_ALNUM)
        prefix = C.prefix_hashes(low)
        n = (end - start) // PIECE + 1
        self.word = np.repeat(np.arange(len(start)), n)
        place = np.arange(len(self.word)) - np.repeat(np.cumsum(n) - n, n)
        a = start[self.word] + PIECE * place
        b = np.minimum(a + PIECE, end[self.word])
        self.piece = C.mix(C.span_hashes(prefix, a, b) + (b - a).astype(np.uint64))
        self.context = C.mix(C.span_hashes(prefix, start[self.word], a) + np.uint64(PIECE + 1))
        self.lead = place == 0
        self.first = self.piece[self.lead]
        before = np.full(len(start), _START, dtype=np.uint64)
        follows = self.doc[1:] == self.doc[:-1]
        before[1:][follows] = C.mix(self.first[:-1] + np.uint64(PIECE + 2))[follows]
        self.context[self.lead] = before

    def pairs(self) -> np.ndarray:
        return pair(self.context, self.piece)


def pair(context: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return C.mix(context * np.uint64(0x9E3779B97F4A7C15) ^ piece)


def count(rows: DataFrame) -> DataFrame:
    """(context, piece, first, lead, toxic, ordinary): occurrences of each pair in all rows (_t text, _y label).

    first is the first piece of the word, lead whether the piece is that. Counts
    are summed over a task's rows before they are shuffled.
    """
    names = ["context", "piece", "first", "lead"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, "_t"))
            label = np.asarray(C.column(batch, "_y").to_pylist(), dtype=np.int64)
            for lo, _, raw, o, again in C.slices(data, off, C.IN_ALNUM):
                p = Pieces(raw, o)
                own = p.word > 0 if again else slice(None)
                y = label[lo + p.doc[p.word[own]]]
                held.append(_summed(p.context[own], p.piece[own], p.first[p.word[own]], p.lead[own], y, 1 - y))
                if len(held) >= 16:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) > 1 << 19:
                        yield batch_of(held.pop())
        if held:
            yield batch_of(_summed(*map(np.concatenate, zip(*held))))

    def batch_of(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(v.view(np.int64)) for v in x[:3]), *map(pa.array, x[3:])], [*names, "toxic", "ordinary"])

    out = rows.mapInArrow(work, "context long, piece long, first long, lead boolean, toxic long, ordinary long")
    return out.groupBy(*names).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _summed(context, piece, first, lead, toxic, ordinary) -> tuple[np.ndarray, ...]:
    _, at, place = np.unique(pair(context, piece), return_index=True, return_inverse=True)
    n = [np.bincount(place, weights=x, minlength=len(at)).astype(np.int64) for x in (toxic, ordinary)]
    return context[at], piece[at], first[at], lead[at], *n


class Table:
    """Two values of each key. Keys are hashes, so their upper bits tell nearly where each stands."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.stack((a, b))[:, order]
        self.shift = np.uint64(64 - max(1, len(keys)).bit_length())
        self.begin = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, keys: np.ndarray, otherwise: tuple[float, float]) -> np.ndarray:
        at = self.begin[(keys >> self.shift).view(np.int64)]
        todo = np.flatnonzero(self.keys[at] < keys)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < keys[todo]]
        known = np.flatnonzero((self.keys[at] == keys) & (at < len(self.keys) - 1))
        out = np.empty((2, len(keys)))
        for row, value, own in zip(out, otherwise, self.values):
            row[:] = value
            row[known] = own[at[known]]
        return out


class Block:
    """The part of the models that scores words whose first piece falls into one block: of pairs the discounted share, of contexts the mass set free, of pieces their probability."""

    def __init__(self, number: int, blocks: int, pairs: Table, contexts: Table, pieces: Table, unknown: tuple[float, float]):
        self.number, self.blocks, self.pairs, self.contexts, self.pieces, self.unknown = number, blocks, pairs, contexts, pieces, unknown

    def differences(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Toxic less ordinary log-likelihood of each word, and whether the word is of this block."""
        below = self.pieces.of(p.piece, self.unknown)
        both = self.pairs.of(p.pairs(), (0.0, 0.0)) + self.contexts.of(p.context, (1.0, 1.0)) * below
        own = _block_of(p.first, self.blocks) == self.number
        return np.bincount(p.word, weights=np.log(both[0] / both[1]), minlength=len(p.first)), own

    def evidence(self, raw: np.ndarray, off: np.ndarray, again: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per document, the sum over this block's words of toxic less ordinary log-likelihood, where the toxic model writes but SHARE of a text; and all words."""
        p = Pieces(raw, off)
        d, own = self.differences(p)
        if again:
            own[:1] = False
        gain = np.where(own, np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + d), 0.0)
        n = np.bincount(p.doc, minlength=len(off) - 1)
        return np.bincount(p.doc, weights=gain, minlength=len(off) - 1), n - again


def _block_of(first: np.ndarray, blocks: int) -> np.ndarray:
    return (first >> np.uint64(33)).astype(np.int64) % blocks


def _block_column(blocks: int) -> Column:
    return F.shiftrightunsigned("first", 33) % blocks


class Model:
    """Tables of both models, as rows written to the shared folder, and the calibration. Without rows the score is constant."""

    def __init__(self, pairs: DataFrame | None = None, contexts: DataFrame | None = None, pieces: DataFrame | None = None, unknown: tuple[float, float] = (1.0, 1.0), block_rows: int = BLOCK_ROWS):
        self.pairs, self.contexts, self.pieces, self.unknown = pairs, contexts, pieces, unknown
        self.scale, self.shift = 0.0, 0.0
        self.blocks = 1 if pairs is None else max(1, -(-(pairs.count() + contexts.filter("NOT lead").count()) // block_rows))

    def block(self, number: int) -> Block:
        """One block's tables. Contexts that begin a word and pieces are part of all: there are no more of them than strings of PIECE bytes."""
        none = Table(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
        if self.pairs is None:
            return Block(0, 1, none, none, none, self.unknown)

        def table(df: DataFrame) -> Table:
            got = df.select("key", "a", "b").toArrow()
            return Table(np.asarray(got["key"]).astype(np.int64).view(np.uint64), np.asarray(got["a"]), np.asarray(got["b"]))

        own = _block_column(self.blocks) == number
        return Block(number, self.blocks, table(self.pairs.filter(own)), table(self.contexts.filter(F.col("lead") | own)), table(self.pieces), self.unknown)

    def calibrated(self, z: Column) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), self.scale * z + self.shift))))

    def discard(self) -> None:
        if self.pairs is not None:
            C.discard(self.pairs, self.contexts, self.pieces)


def estimate(counts: DataFrame, block_rows: int = BLOCK_ROWS) -> Model:
    """Both models from the counts of pairs; all estimates are made in Spark."""
    counts = C.written(counts, "pairs")
    C.release_shuffles(counts.sparkSession)  # of the texts, and of the pairs of each task
    nt, no = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not nt or not no:
        C.discard(counts)
        return Model()
    dt, do = DISCOUNT * max(1.0, nt / no), DISCOUNT * max(1.0, no / nt)
    rows = counts.withColumn("telling", (F.col("toxic") > dt) | (F.col("ordinary") > do))
    freed = [F.sum(F.least(F.col(c).cast("double"), F.lit(d))).alias(f"free_{c}") for c, d in (("toxic", dt), ("ordinary", do))]
    contexts = rows.groupBy("context").agg(F.sum("toxic").alias("nt"), F.sum("ordinary").alias("no"), *freed, F.max("lead").alias("lead"), F.min("first").alias("first"), F.max("telling").alias("telling"))
    contexts = C.written(contexts.filter("telling"), "contexts")
    pieces = rows.groupBy("piece").agg(F.count_if(F.col("toxic") > 0).alias("kt"), F.count_if(F.col("ordinary") > 0).alias("ko"), F.count("*").alias("k"), F.max("telling").alias("telling"))
    pieces = C.written(pieces, "pieces")
    C.release_shuffles(counts.sparkSession)
    kt, ko, k, v = pieces.agg(F.sum("kt"), F.sum("ko"), F.sum("k"), F.count("*")).first()
    et, eo = DISCOUNT * max(1.0, kt / ko), DISCOUNT * max(1.0, ko / kt)
    lt, lo = pieces.agg(*[F.sum(F.least(F.col(c).cast("double"), F.lit(e))) / n for c, e, n in (("kt", et, kt), ("ko", eo, ko))]).first()

    def share(n: str | Column, d: float, total: str) -> Column:
        return F.when(F.col(total) > 0, F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(total)).otherwise(0.0)

    def mass(free: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(free) / F.col(total)).otherwise(1.0)

    def below(n: str, e: float, total: float, left: float) -> Column:
        return F.greatest(F.col(n) - e, F.lit(0.0)) / total + left * (F.col("k") + 1) / (k + v + 1)

    kept = rows.filter("telling").join(contexts.select("context", "nt", "no"), "context").select("context", "piece", "first", share("toxic", dt, "nt").alias("a"), share("ordinary", do, "no").alias("b"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            c, p = (np.asarray(C.column(x, n)).astype(np.int64).view(np.uint64) for n in ("context", "piece"))
            yield pa.RecordBatch.from_arrays([pa.array(pair(c, p).view(np.int64)), *(C.column(x, n) for n in ("first", "a", "b"))], ["key", "first", "a", "b"])

    model = Model(
        C.written(kept.mapInArrow(hashed, "key long, first long, a double, b double"), "model-pairs"),
        C.written(contexts.select(F.col("context").alias("key"), "first", "lead", mass("free_toxic", "nt").alias("a"), mass("free_ordinary", "no").alias("b")), "model-contexts"),
        C.written(pieces.filter((F.col("kt") > et) | (F.col("ko") > eo) | F.col("telling")).select(F.col("piece").alias("key"), below("kt", et, kt, lt).alias("a"), below("ko", eo, ko, lo).alias("b")), "model-pieces"),
        (lt / (k + v + 1), lo / (k + v + 1)),
        block_rows,
    )
    C.discard(counts, contexts, pieces)
    return model


def evidence(df: DataFrame, model: Model, text: str) -> DataFrame:
    """df without its text, with `_kl_z`: what the models say of each row, block by block."""
    names = [x for x in df.columns if x != text]
    spark, out = df.sparkSession, df
    if model.pairs is None:
        return df.select(*names, F.lit(0.0).alias("_kl_z"))
    for number in range(model.blocks):
        last = number == model.blocks - 1
        out = _summed_up(out, spark, model.block(number), text, names, number > 0, last)
        if not last:
            out = C.written(out, "block")
    return out


def _summed_up(df: DataFrame, spark: SparkSession, block: Block, text: str, names: list[str], more: bool, last: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, off = C.text_bytes(C.column(batch, text))
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for lo, hi, raw, o, again in C.slices(data, off, C.IN_ALNUM):
                z, words = own.evidence(raw, o, again)
                total[lo:hi] += z
                n[lo:hi] += words
            if more:
                total += np.asarray(C.column(batch, "_kl_z"))
            if last:
                total = np.arcsinh(total / np.maximum(1, n) / UNIT)
            kept = names if last else [*names, text]
            yield pa.RecordBatch.from_arrays([C.column(batch, x) for x in kept] + [pa.array(total)], [*kept, "_kl_z"])

    fields = [df.schema[x] for x in (names if last else [*names, text])]
    return df.mapInArrow(work, T.StructType(fields + [T.StructField("_kl_z", T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", calibration_rows: int = CALIBRATION_ROWS, block_rows: int = BLOCK_ROWS) -> Model:
    """Count all labelled rows of folds 2 to 4, and calibrate on at most calibration_rows of fold 1; fold 0 is never read.

    Labels grow with the corpus, so both sides of their join are shuffled at any
    size. Null labels, keys and texts are passed over, repeated rows count each;
    of no label, or one label only, the score is constant.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold(key) > 0)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    rows = docs.filter(F.col(text).isNotNull() & F.col(key).isNotNull() & (fold(key) > 0)).select(F.col(key).alias("_k"), F.col(text).alias("_t"), fold(key).alias("_f"))
    # written, so that the shuffled texts are gone before the pairs are shuffled
    counted = C.written(rows.filter("_f > 1").join(known.hint("merge"), "_k").select("_t", "_y"), "labelled")
    C.release_shuffles(docs.sparkSession)
    model = estimate(count(counted), block_rows)
    C.discard(counted)
    some = known.filter(fold("_k") == 1).withColumn("_o", F.xxhash64(F.col("_k").cast("string"), F.lit(5))).orderBy("_o", "_k").limit(calibration_rows).select("_k", "_y")
    held = rows.filter("_f = 1").join(F.broadcast(some), "_k").select("_k", "_y", "_t")
    got = evidence(held, model, "_t").orderBy("_k", "_kl_z").select("_y", "_kl_z").toArrow()
    y, z = np.asarray(got["_y"]).astype(np.float64), np.asarray(got["_kl_z"])
    if len(y) and y.min() != y.max():
        model.scale, model.shift = _logistic(z, y, np.ones(len(y)))
    else:
        model.scale, model.shift = (0.0, -3.0) if not len(y) or y.max() == 0 else (0.0, 3.0)
    return model


def report(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score (0 to 1) and predicted (1 from 0.5). Null and empty texts are scored as having no words; of other columns none is read, so none can clash."""
    out = evidence(docs.select(F.col(key).alias("_kl_k"), F.col(text).alias("_kl_t")), model, "_kl_t")
    out = out.select(F.col("_kl_k").alias(key), F.coalesce(fold("_kl_k") == 0, F.lit(False)).alias("held_out"), model.calibrated(F.col("_kl_z")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
