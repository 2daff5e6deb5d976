"""Decontamination, quality and toxicity."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import common, decontaminate, quality, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def _expected(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(item))
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, own = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    own |= windows[tuple(w[j : j + n])]
                    hit[j : j + n] = [1] * n
        yield doc, (len(w), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))


@pytest.mark.parametrize("block", [1, decontaminate.BLOCK_BYTES])
def test_hits_match_brute_force(spark, some_docs, block):
    texts = {r.doc_id: r.text for r in some_docs.collect()}
    items = [(7, " ".join(texts[0].split()[5:30]).upper()), (70, "same SAME, same"), (8, "  "), (9, None), (10, " ".join(texts[4].split()[:13]) + " " + " ".join(texts[6].split()[:14])), (11, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(some_docs, bench, block_bytes=block).collect()}
    assert got == dict(_expected(texts.items(), items))
    kept = {r.doc_id for r in decontaminate.decontaminated(some_docs, bench).collect()}
    assert kept == {k for k, v in got.items() if not v[4]}


def test_broadcast_windows_are_within_their_bound():
    rng = np.random.default_rng(8)
    for text in (" ".join("ab"[x] for x in rng.integers(0, 2, 200_000)), " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200_000))):
        grams = decontaminate.Grams([(1, text), (2, text)])
        assert grams.size() <= 11 * 2 * (len(text) + 64)


def test_hash_collisions_hit_nothing():
    grams = decontaminate.Grams([(1, "a b c"), (2, "d e f"), (3, "a b c")])
    keys, item, begin, stop = grams.windows[3]
    grams.windows[3] = np.full_like(keys, keys[0]), item, begin, stop  # all collide
    raw = np.frombuffer(b"a b c x d e f", dtype=np.uint8)
    assert next(grams.scan(raw, np.array([0, len(raw)])))[2] in (["1", "3"], ["2"])


def test_spans_are_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after é."), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, spans=True).collect()}
    assert got == {1: "Before, ! after é.", 2: "clean", 3: None}


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
    repeated = {j + k for j in range(len(words) - 2) if runs[tuple(words[j : j + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_base_counts(odd_docs, some_docs):
    texts = [r.text or "" for r in odd_docs.collect() + some_docs.collect()] + ["x #a\nx #a\n\n x #a\n", "a b c a b c a", "\n", "é é é é <>|"]
    data, off = common.text_bytes(pa.array(texts))
    got = quality.base_counts(data, off)
    names = quality.SCORED.names[:5]
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [_base(t) for t in texts]


def test_quality_learns_and_keeps_clean_documents(spark):
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(vocab, 60).tolist()
        good = i % 4 > 0
        rows.append((i, " ".join(words if good else [w + "%%%" for w in words])))
        labels.append((i, int(good)))
    rows.append((1000, "short"))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels[:300], (5000, 1), (None, 1), (301, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, quality.train(docs, known)).collect()}
    held = [got[i].kept == bool(labels[i][1]) for i in range(300, 400)]
    assert np.mean(held) > 0.95
    assert got[1000].base_failed and not got[1000].kept


def test_toxicity_never_reads_held_out_labels(spark):
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = rng.choice(vocab, 50).tolist()
        bad = i % 6 == 0
        if bad:
            for k in (4, 20, 33):
                words[k] = ["vile", "nasty", "rotten", "foulx" + "".join(rng.choice(list("mnop"), 3))][rng.integers(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, toxicity.train(docs, known)).collect()}
    held = [i for i in got if got[i].held_out]
    assert 200 < len(held) < 400
    right = [got[i].predicted == labels[i][1] for i in held]
    assert np.mean(right) > 0.95
    turned = known.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.report(docs, toxicity.train(docs, turned)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)


def test_decontamination_matches_its_sql(spark):
    from oracle import compare, connect

    from keyloom.llm import queries

    sf = "/root/testdata/sf0.01"
    compare(spark, connect(sf), sf, queries.op2_decontaminate, queries.OP2_SQL)
