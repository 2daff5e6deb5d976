"""Token-id files in a word-aligned code.

A file holds blocks of ids. Each 64-bit word has a 4-bit selector and 60 bits
of payload that it deals out to a fixed count of ids; ids too wide for any
selector follow an escape word as a word of their own. Block offsets at the end
of the file let a reader decode any block by itself, with a handful of vector
operations for each selector.

    magic | block 0 | block 1 | ... | doc ids | doc lengths | block table | footer
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from . import common as C

MAGIC = b"KLTOKEN1"
#: Selector: (ids in the word, bits of each). Selector 0 is the escape, 1 a run of zeros.
SELECTORS = {1: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
BLOCK_IDS = 1 << 16
#: A writer starts its next file after so many ids.
FILE_IDS = 32 << 20
END_ID = 2
#: Bytes of text that are tokenised at once.
TEXT_BYTES = 2 << 20
#: Bytes of new pieces that are encoded as one text.
RUN_BYTES = 1 << 16
#: Text pieces whose ids a worker remembers, about: some 30 bytes each.
CACHE_PIECES = 800_000
_COUNT = np.array([1] + [SELECTORS[s][0] for s in range(1, 16)])


_SMALL_WIDTHS = np.repeat(np.arange(18), [1, *(1 << np.arange(17))]).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; 61 stands for the escape."""
    if ids.max() < len(_SMALL_WIDTHS):
        return _SMALL_WIDTHS[ids.astype(np.int64)]
    out = np.zeros(len(ids), dtype=np.uint8)
    left = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= (np.uint64(1) << np.uint64(step))
        out[big] += step
        left[big] >>= np.uint64(step)
    out += left > 0
    return np.minimum(out, 61)


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words for the ids of one block, chosen greedily: each word takes as many ids as fit."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    widest = {1: np.concatenate((_widths(ids), np.zeros(128, np.uint8)))}
    for k in (2, 4, 8, 16, 32, 64):
        half = widest[k // 2]
        widest[k] = np.maximum(half, np.concatenate((half[k // 2 :], np.zeros(k // 2, np.uint8))))
    chosen = np.zeros(n, dtype=np.uint8)
    for s in range(15, 0, -1):
        count, bits = SELECTORS[s]
        k = 1 << (count.bit_length() - 1)
        chosen[np.maximum(widest[k][:n], widest[k][count - k : count - k + n]) <= bits] = s
    step, at, starts = _COUNT[chosen].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    which = chosen[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(which == 0)[:-1]))
    words = np.zeros(len(starts) + int((which == 0).sum()), dtype=np.uint64)
    padded = np.concatenate((ids, np.zeros(128, np.uint64)))
    words[place[which == 0] + 1] = ids[starts[which == 0]]
    for s in np.unique(which[which > 0]).tolist():
        count, bits = SELECTORS[s]
        own = starts[which == s]
        word = np.full(len(own), s << 60, dtype=np.uint64)
        for j in range(count if bits else 0):
            value = padded[own + j]
            value[own + j >= n] = 0
            word |= value << np.uint64(j * bits)
        words[place[which == s]] = word
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (selector == 0).any():  # the word after an escape is no code word
        for i in np.flatnonzero(selector == 0).tolist():
            if not (i and raw[i]):
                raw[i + 1] = True
    code = np.flatnonzero(~raw)
    which = selector[code]
    begin = np.concatenate(([0], np.cumsum(_COUNT[which])))
    out = np.zeros(int(begin[-1]), dtype=np.uint64)
    out[begin[:-1][which == 0]] = words[code[which == 0] + 1]
    for s in np.unique(which[which > 1]).tolist():
        count, bits = SELECTORS[s]
        own, to = words[code[which == s]], begin[:-1][which == s]
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[to + j] = (own >> np.uint64(j * bits)) & mask
    return out[:n]


class Writer:
    """Writes one file; ids of a document may run over several blocks."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.blocks, self.docs, self.lengths, self.held, self.n_held, self.total = [], [], [], [], 0, 0
        stream.write(MAGIC)

    def add(self, keys: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents with their ids one after the other."""
        self.docs += [-(2**63) if k is None else k for k in keys]
        self.lengths.append(lengths)
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        lo = 0
        while len(ids) - lo >= BLOCK_IDS or last and lo < len(ids):
            own = ids[lo : lo + BLOCK_IDS]
            words = encode_block(own)
            self.stream.write(words.astype("<u8").tobytes())
            self.blocks.append((self.at, len(words), len(own)))
            self.at += 8 * len(words)
            lo += len(own)
        self.held, self.n_held = [ids[lo:]], len(ids) - lo

    def close(self) -> None:
        self._flush(True)
        self.stream.write(np.array(self.docs, dtype="<i8").tobytes())
        self.stream.write(np.concatenate(self.lengths or [np.zeros(0)]).astype("<i8").tobytes())
        self.stream.write(np.array(self.blocks, dtype="<i8").reshape(-1, 3).tobytes())
        self.stream.write(struct.pack("<qqq", self.at, len(self.docs), len(self.blocks)))
        self.stream.close()


class Reader:
    """Reads one file by blocks."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 24)
        at, n_docs, n_blocks = struct.unpack("<qqq", stream.read(24))
        stream.seek(at)
        self.docs = np.frombuffer(stream.read(8 * n_docs), dtype="<i8")
        self.lengths = np.frombuffer(stream.read(8 * n_docs), dtype="<i8")
        self.blocks = np.frombuffer(stream.read(24 * n_blocks), dtype="<i8").reshape(-1, 3)

    def block(self, k: int) -> np.ndarray:
        at, words, n = self.blocks[k].tolist()
        self.stream.seek(at)
        return decode_block(np.frombuffer(self.stream.read(8 * words), dtype="<u8"), n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, n_held, k = [], 0, 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist()):
            while n_held < n:
                held.append(self.block(k))
                n_held += len(held[-1])
                k += 1
            ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, np.uint64)
            yield (None if doc == -(2**63) else doc), ids[:n]
            held, n_held = [ids[n:]], n_held - n


_TOKENIZERS: dict[str, "Encoder"] = {}
#: Texts beside whose parts cuts are not certain: special tokens, the mark used for cutting, white space at an end, in runs or of a rarer kind.
_ODD = r"<\||\x00|[ \n][ \n]|^[ \n]|[ \n]$|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Token ids of texts.

    The vocabulary's pre-tokeniser always cuts before a single space that stands
    between two other characters, and on both sides of such a line break; so a
    text without double white space is the concatenation of its pieces. A batch's
    distinct pieces are looked up among the pieces met of late; new ones are
    encoded together, as one text, and told apart by the bytes that each token
    stands for. Any other text is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():  # in this vocabulary a character of a token is a byte
            self.bytes[i] = len(token)

    @staticmethod
    def of(path: str) -> "Encoder":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = Encoder(path)
        return _TOKENIZERS[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """Remembered pieces: two hashes of each, in order of the first, and where its ids are in the pool."""
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def _encode(self, pieces: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of ids of each piece). Pieces that begin with a space are run together with no more than cuts that the pre-tokeniser makes itself."""
        led = first == 0x20
        together, heads = pieces.filter(pa.array(led)), pieces.filter(pa.array(~led))
        size = np.zeros(len(pieces), dtype=np.int32)
        data, off = C.text_bytes(together)
        runs = [self._whole([data[off[lo] : off[hi]].tobytes().decode()])[0] for lo, hi in C.chunks(off, RUN_BYTES)]
        ids = np.frombuffer(b"".join(runs), dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), off[1:]) + 1 if len(ids) else off[1:]
        size[led] = np.diff(ends, prepend=0)
        rest = [np.frombuffer(x, "<u4") for x in self._whole(heads.to_pylist())]
        size[~led] = [len(x) for x in rest]
        if not rest:
            return ids, size
        out = np.empty(int(size.sum()), dtype="<u4")
        out[np.repeat(led, size)] = ids
        out[np.repeat(~led, size)] = np.concatenate(rest)
        return out, size

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids begin, and how many they are."""
        data, off = C.text_bytes(pieces)
        prefix = C.prefix_hashes(data)
        hashes = C.span_hashes(prefix, off[:-1], off[1:])
        keys, checks = C.mix(hashes), (C.mix(hashes + np.uint64(77) + np.diff(off).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            first = np.where(np.diff(off)[fresh] > 0, data[np.minimum(off[:-1][fresh], max(0, len(data) - 1))], 0) if len(data) else np.zeros(len(fresh))
            ids, size = self._encode(pieces.take(pa.array(fresh)), first)
            begin = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate((self.pool, ids))
            order = np.argsort(keys[fresh], kind="stable")
            place = np.searchsorted(self.keys, keys[fresh][order])
            self.keys, self.checks = np.insert(self.keys, place, keys[fresh][order]), np.insert(self.checks, place, checks[fresh][order])
            self.begin, self.size = np.insert(self.begin, place, begin[order]), np.insert(self.size, place, size[order])
            at = np.searchsorted(self.keys, keys)
        return self.begin[at].astype(np.int64), self.size[at].astype(np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.if_else(odd, "", texts)
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00")
        split = pc.split_pattern(marked, "\x00")
        coded = split.flatten().dictionary_encode()
        which = np.asarray(coded.indices)
        begin, size = self._pieces(coded.dictionary)
        n = size[which]
        to = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(begin[which] - to[:-1], n)
        place += np.arange(to[-1])
        flat = self.pool[place]
        bounds = to[np.asarray(split.offsets) - split.offsets[0].as_py()]
        if not pc.any(odd).as_py():
            return flat, bounds
        at = np.flatnonzero(np.asarray(odd))
        parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i, found in zip(at.tolist(), self._whole(texts.take(pa.array(at)).to_pylist())):
            parts[i] = np.frombuffer(found, dtype="<u4")
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int | None = END_ID, n_files: int | None = None) -> DataFrame:
    """Tokenise and write files under `path` in ascending order of key; returns a written table (part, seq, file, n_docs, n_ids), a row for each file.

    Null texts count as empty. Rows of one key follow each other in order of
    their text's hash; a null key comes first. A task writes under a name of its
    own and renames when done, so tasks can be run again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"))
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n_files, "_k").sortWithinPartitions("_k", F.xxhash64("_t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        part, seq, writer, made = TaskContext.get().partitionId(), 0, None, []
        encoder = Encoder.of(tokenizer)
        def close():
            writer.close()
            done = f"{root}/part-{part:06d}-{seq:04d}.s8b"
            store.move(temporary, done)
            made.append((part, seq, done, len(writer.docs), writer.total))

        for batch in batches:
            keys, texts = C.column(batch, "_k").to_pylist(), C.column(batch, "_t")
            _, off = C.text_bytes(texts)
            for lo, hi in C.chunks(off, TEXT_BYTES):
                ids, bounds = encoder.ids(texts[lo:hi])
                if end_id is not None:
                    ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                if writer is None:
                    store.create_dir(root, recursive=True)
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    writer = Writer(store.open_output_stream(temporary))
                writer.add(keys[lo:hi], ids, np.diff(bounds))
                if writer.total >= FILE_IDS:
                    close()
                    writer, seq = None, seq + 1
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pydict({x: [m[i] for m in made] for i, x in enumerate(("part", "seq", "file", "n_docs", "n_ids"))}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return C.written(rows.mapInArrow(work, "part int, seq int, file string, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """From the files that write() listed: doc_id, start, n_tokens, ids_crc32, and with `ids` the ids as an array.

    The listing has a row for each file, so it is summed up on the driver; each file is read by one task.
    """
    spark = files.sparkSession
    at, listed = 0, []
    for r in files.orderBy("part", "seq").toLocalIterator():
        listed.append((r.file, at))
        at += r.n_ids
    jobs = spark.createDataFrame(listed, "file string, start long").repartition(max(1, len(listed)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for job in batch.to_pylist():
                start, rows = job["start"], []
                with store.open_input_file(job["file"]) as stream:
                    for doc, found in Reader(stream).documents():
                        rows.append((doc, start, len(found), zlib.crc32(found.astype("<u4").tobytes())) + ((found.astype(np.int64),) if ids else ()))
                        start += len(found)
                        if len(rows) >= 2000:
                            yield _rows(rows, ids)
                            rows = []
                yield _rows(rows, ids)

    return jobs.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def _rows(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if ids:
        cols.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)
