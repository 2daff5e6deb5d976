"""Kneser-Ney models against a plain version of their formulas."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import common, toxicity

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _pieces(text):
    """(context, piece) of each piece of each word."""
    before, out = None, []
    for w in WORD.findall(text.encode().lower()):
        own = [(("in", w[:i]) if i else ("after", before), w[i : i + toxicity.PIECE]) for i in range(0, len(w) + 1, toxicity.PIECE)]
        before = w[: toxicity.PIECE]
        out.append(own)
    return out


class Plain:
    """Interpolated Kneser-Ney models of both classes, sharing their last backoff."""

    def __init__(self, rows):
        self.n = [Counter(), Counter()]
        for text, y in rows:
            self.n[y].update(p for w in _pieces(text) for p in w)
        size = [sum(c.values()) for c in self.n]
        self.d = [toxicity.DISCOUNT * max(1, size[y] / size[1 - y]) for y in (0, 1)]
        self.of = [Counter(), Counter()]
        self.free = [Counter(), Counter()]
        self.k = [Counter(), Counter()]
        for y in (0, 1):
            for (v, w), n in self.n[y].items():
                self.of[y][v] += n
                self.free[y][v] += min(n, self.d[y])
                self.k[y][w] += 1
        self.both = Counter(w for v, w in {*self.n[0], *self.n[1]})
        size = [sum(c.values()) for c in self.k]
        self.e = [toxicity.DISCOUNT * max(1, size[y] / size[1 - y]) for y in (0, 1)]
        self.left = [sum(min(n, self.e[y]) for n in self.k[y].values()) / size[y] for y in (0, 1)]
        self.size = size

    def backoff(self, w, y):
        shared = (self.both[w] + 1) / (sum(self.both.values()) + len(self.both) + 1)
        return max(self.k[y][w] - self.e[y], 0) / self.size[y] + self.left[y] * shared

    def p(self, w, v, y):
        if not self.of[y][v]:
            return self.backoff(w, y)
        return max(self.n[y][v, w] - self.d[y], 0) / self.of[y][v] + self.free[y][v] / self.of[y][v] * self.backoff(w, y)

    def difference(self, word):
        return sum(math.log(self.p(w, v, 1) / self.p(w, v, 0)) for v, w in word)


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 11))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = rng.choice(vocab, rng.integers(1, 60)).tolist()
        bad = i % 5 == 0
        for k in range(len(words)):
            if bad and k % 9 == 4:
                words[k] = ["Vile", "nastyx", "rot" + "".join(rng.choice(list("mnop"), 4))][rng.integers(3)]
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def learnt(spark):
    rows = _texts(300, 1) + [(1000, "", 1), (1001, "one", 0)]
    counts = toxicity.count(spark.createDataFrame([r[1:] for r in rows], "_t string, _y int").repartition(5))
    return rows, counts, Plain([r[1:] for r in rows])


def test_the_plain_models_are_distributions(learnt):
    _, _, plain = learnt
    unknown = b"\xff\xff"
    for y in (0, 1):
        for v in [*list(plain.of[y])[:40], ("after", b"never")]:
            assert sum(plain.p(w, v, y) for w in [*plain.both, unknown]) == pytest.approx(1)
    assert plain.p(unknown, ("after", b"never"), 1) > 0


@pytest.mark.parametrize("block_rows", [20, toxicity.BLOCK_ROWS])
def test_differences_match_the_plain_models(learnt, block_rows):
    rows, counts, plain = learnt
    model = toxicity.estimate(counts, block_rows)
    assert (model.blocks > 2) == (block_rows == 20)
    texts = [t for _, t, _ in rows[:60]] + ["never met these words vile vile rotmm nastyx", "abc " * 30, "", "déé"]
    data, off = common.text_bytes(pa.array(texts))
    p = toxicity.Pieces(data, off)
    got, seen = np.zeros(len(p.first)), np.zeros(len(p.first), int)
    for b in range(model.blocks):
        d, own = model.block(b).differences(p)
        got[own] = d[own]
        seen += own
    assert (seen == 1).all()
    want = [plain.difference(w) for t in texts for w in _pieces(t)]
    assert np.allclose(got, want)


def test_blocks_give_the_same_scores(spark):
    rows = _texts(400, 2)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (None, "abc")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scores = []
    for block_rows in (30, toxicity.BLOCK_ROWS):
        model = toxicity.train(docs, labels, block_rows=block_rows)
        scores.append({r.doc_id: r.score for r in toxicity.report(docs, model).collect()})
        model.discard()
    assert len(scores[0]) == 402 and all(abs(scores[0][k] - scores[1][k]) < 1e-9 for k in scores[0])
    right = [(scores[0][r[0]] >= 0.5) == bool(r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean(right) > 0.9


def test_long_texts_are_scored_in_parts(learnt, monkeypatch):
    rows, counts, _ = learnt
    model = toxicity.estimate(counts)
    block = model.block(0)
    text = " ".join(t for _, t, _ in rows) + ", " + "x" * 300 + "! vile."
    data, off = common.text_bytes(pa.array(["short vile one", text, "", "end"]))
    whole = block.evidence(data, off, False)
    for most in (50, 200, 1000):
        total, n, parts = np.zeros(4), np.zeros(4, int), 0
        for lo, hi, raw, o, again in common.slices(data, off, common.IN_ALNUM, most):
            z, words = block.evidence(raw, o, again)
            total[lo:hi] += z
            n[lo:hi] += words
            parts += 1
        assert parts > 10 and np.allclose(total, whole[0]) and (n == whole[1]).all()


def test_odd_labels(spark, odd_docs, no_docs):
    for labels in ([], [(4, 1), (5, 1)], [(1, None), (None, 1)], [(i, i % 2) for i in range(12)] * 2):
        known = spark.createDataFrame(labels, "doc_id long, toxic int")
        for docs in (odd_docs, no_docs):
            got = toxicity.report(docs, toxicity.train(docs, known)).collect()
            assert len(got) == docs.count()
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
            by = defaultdict(set)
            for r in got:
                by[r.doc_id].add(r.score)
            assert all(len(v) == 1 for k, v in by.items() if k in (0, 4))
