"""Shared helpers: written intermediate tables and byte-level text scanning."""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a scan works on at once; bounds a Python worker's memory.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Per byte, whether it belongs to a word: anything but ASCII white space.
IN_WORD = ~_SPACE
#: Per byte, whether it belongs to a normalised word: digit, letter or not ASCII.
IN_ALNUM = np.zeros(256, dtype=bool)
IN_ALNUM[0x30:0x3A] = IN_ALNUM[0x41:0x5B] = IN_ALNUM[0x61:0x7B] = IN_ALNUM[0x80:] = True
#: Lower case of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_UNIT = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there.

    Zstandard, as the default codec compresses in buffers outside of the heap,
    which many short tasks heap up faster than garbage collection frees them.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kl_path = path
    return out


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package, wherever the driver was started. On a cluster it is shipped with the job."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    return spark


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._kl_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps: they go once their handles are collected, a moment later."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def trim() -> None:
    """Give memory that the driver's Python has freed back to the system, where the C library can."""
    gc.collect()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes; a longer document is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def tokens(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes that `inside` marks; runs end with their document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64: span_hashes() takes the hash of any span from them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_UNIT[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal spans get equal hashes wherever they stand. Not yet mixed."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def run_hashes(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first, hash) of each run of n neighbours with one owner."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + hashes[at + j]
    return at, mix(out)


#: Bytes, about, of a table made on the driver that is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows made on the driver, to be joined: broadcast up to BROADCAST_BYTES, as Spark does not know its size."""
    df = spark.createDataFrame(rows, schema)
    size = sum(16 + len(x) if isinstance(x, str) else 16 for row in rows for x in row)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def unused(name: str, names: list[str]) -> str:
    """name, lengthened until none of names is like it."""
    taken = {x.lower() for x in names}
    while name.lower() in taken:
        name += "_"
    return name


def slices(data: np.ndarray, off: np.ndarray, inside: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(lo, hi, data, offsets, again): the documents by chunks, those longer than `most` bytes cut between words.

    A later part of a long document begins with the last word of the part before
    (`again`), so that it is known what each word follows.
    """
    for lo, hi in chunks(off, most):
        a, b = int(off[lo]), int(off[hi])
        again = False
        while b - a > most and hi == lo + 1:
            gap = np.flatnonzero(~inside[data[a + 1 : a + most]])
            edge = gap[1:][np.diff(gap) > 1] if len(gap) else gap  # a gap after a word
            if not len(edge) or again and len(edge) < 2:
                break  # one word fills the part
            end = a + 1 + int(edge[-1])
            yield lo, hi, data[a:end], np.array([0, end - a]), again
            word = np.flatnonzero(inside[data[a:end]])
            last = int(word[-1])
            before = np.flatnonzero(~inside[data[a : a + last]])
            a, again = a + (int(before[-1]) + 1 if len(before) else 0), True
        yield lo, hi, data[a:b], off[lo : hi + 1] - off[lo] if not again else np.array([0, b - a]), again


def word_hashes(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, hashes, documents): the lower-cased words of documents lo to hi, in order; long documents are read in parts."""
    for (lo, hi), parts in itertools.groupby(slices(data, off, inside), key=lambda x: x[:2]):
        hashes, docs = [], []
        for _, _, raw, o, again in parts:
            low = LOWER[raw]
            start, end, doc = tokens(low, o, inside)
            hashes.append(mix(span_hashes(prefix_hashes(low), start, end))[int(again) :])
            docs.append(lo + doc[int(again) :])
        yield (lo, hi, hashes[0], docs[0]) if len(hashes) == 1 else (lo, hi, np.concatenate(hashes), np.concatenate(docs))
