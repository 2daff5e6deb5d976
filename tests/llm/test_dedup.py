"""SimHash, sentence spans and suffixes against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import sentence_spans, simhash, suffix_dedup


def _reach(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(some_docs):
    rows = sorted((r.doc_id, r.text) for r in some_docs.collect())
    fps = [_fingerprint(t) for _, t in rows]
    roots = _reach(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = {r.doc_id: r for r in simhash.report(some_docs).collect()}
    assert len(got) == len(rows)
    for (doc, _), fp, root in zip(rows, fps, roots):
        assert got[doc].fingerprint == f"{fp:016x}"
        assert got[doc].component_id == rows[root][0]


@pytest.mark.parametrize("bucket_rows", [2, 2000])
def test_links_of_planted_fingerprints(spark, bucket_rows):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 60, dtype=np.uint64).tolist()
    for i in range(40):  # chains of one and two flipped bits
        fps.append(fps[-1 if i % 5 else i] ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    fps = sorted(set(fps))
    roots = _reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, 2, bucket_rows)).collect()}
    assert [found.get(f, f) for f in fps] == [fps[r] for r in roots]
    assert len(set(roots)) < len(fps) - 30


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(2**40) ^ (np.uint64(1) << rng.integers(0, 6, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))
    member, root = simhash.bucket_links(fps[:, None], 2)
    roots = _reach(len(fps), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 2)
    assert len(fps) - len(member) == len(set(roots))
    assert all(roots[m] == roots[r] for m, r in zip(member, root))


def test_pivots_discard_pairs_of_any_bucket():
    """Fingerprints that share a block of bits: hardly any pair but those within the radius is left to be verified, in buckets of all sizes."""
    rng = np.random.default_rng(5)
    for n in (2, 8, 200):
        fps = rng.integers(0, 2**63, (4000 // n * n, 1), dtype=np.uint64) & np.uint64(2**43 - 1)
        fps[1::n] = fps[::n] ^ np.uint64(5)
        table = simhash.pivot_table(fps, simhash.references(fps, 2))
        begin, kept, pairs = np.arange(0, len(fps), n), 0, 0
        for i, j in simhash._pairs(begin, np.full(len(begin), n)):
            x, y = simhash.survivors(table, i, j, 2)
            assert set(zip(i[simhash.distances(fps, i, j) <= 2], j[simhash.distances(fps, i, j) <= 2])) <= set(zip(x, y))
            pairs += len(i)
            kept += len(x)
        assert kept - len(begin) <= 0.001 * pairs


def test_wide_pivots_are_members():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    fps = np.repeat(base, 40, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (120, 4)).astype(np.uint64))
    table = simhash.pivot_table(fps, simhash.references(fps, 40))
    i, j = np.triu_indices(120, 1)
    x, y = simhash.survivors(table, i, j, 40)
    assert (x // 40 == y // 40).all() and len(x) == 3 * 40 * 39 // 2


def test_long_texts_take_bounded_memory(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE_BYTES", 40)
    monkeypatch.setattr(simhash, "SLICE", 3)
    for text in ("", "a", "A b", "a b c", "one  two\tthree four " * 30, "x" * 200 + " y z " * 20 + "w" * 100, "a\nb " * 7 + "ÄÖ"):
        assert simhash.fingerprint(text.encode()) == _fingerprint(text)


def _near(rows, kept):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for _, t in rows)]
    roots = _reach(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert kept == {rows[i][0] for i in set(roots)}


@pytest.mark.parametrize("bucket_rows", [2, 2000])
def test_near_duplicates_of_similar_shingles(some_docs, bucket_rows):
    rows = sorted((r.doc_id, r.text) for r in some_docs.collect())
    _near(rows, {r.doc_id for r in simhash.deduplicated(some_docs, bucket_rows=bucket_rows).collect()})


@pytest.mark.parametrize("bucket_rows", [10, 2000])
def test_rejected_pairs_leave_the_others_to_be_tried(spark, bucket_rows):
    """Families of variants whose similarities lie around 0.8: a forest of the nearest pairs alone unites too few of them, as do parts of a bucket."""
    rng = np.random.default_rng(2)
    rows = []
    for f in range(3):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(40):
            words = list(base)
            for p in rng.choice(300, 4 if f else 5, replace=False):
                words[p] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _near(rows, {r.doc_id for r in simhash.deduplicated(docs, bucket_rows=bucket_rows).collect()})


def test_null_and_repeated_keys_are_verified(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:99], "other"])
    rows = [(None, " ".join(words)), (None, near), (3, "a b c"), (3, near), (5, " ".join(words)), (6, "d e f g h i")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("3", 3), ("3", 3), ("5", 3), ("6", 6), ("None", 3), ("None", 3)]


def _suffixes(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        b = text.encode()
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cut[p : p + 100] = True
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out[key] = (len(b), int(cut.sum()), int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeated_bytes_go(some_docs, hot):
    docs = some_docs.withColumn("text", F.concat("text", F.lit(" é"), F.col("text")))  # repeats within a document as well
    docs = docs.unionByName(docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000))  # copies
    want = _suffixes([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs, hot=hot).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [1, 20_000])
def test_null_keys_are_documents_of_their_own(spark, some_docs, hot):
    texts = [r.text for r in some_docs.collect() if r.text.count("same") < 9]
    rows = [(None, t) for t in texts for _ in range(2)] + [(1, texts[3])]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, keep_bytes=True).collect()
    ids = {r.doc_id: r.n_removed for r in got if r.doc_id}
    assert len(got) == len(rows) and ids[1] == len(texts[3].encode())
    kept = {r.kept for r in got if not r.doc_id}
    windows = {t.encode()[i : i + 100] for t in texts for i in range(len(t.encode()) - 99)}
    left = b"|".join(kept)
    assert sum(len(r) for r in kept) < sum(len(t.encode()) for t in set(texts))
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in got) and left and windows


def test_ranges_of_other_bytes_are_left_out():
    raw = np.frombuffer(b"abcdefghij", dtype=np.uint8)
    digest = hashlib.sha256(b"cd").digest()
    cut = suffix_dedup.cut_out(raw, np.array([2, 4, 8]), np.array([4, 6, 9]), [digest, digest, None])
    assert np.flatnonzero(cut).tolist() == [2, 3, 8]


def test_suffix_sort_by_hashes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    begin = np.sort(rng.integers(0, 3800, 500))
    s = suffix_dedup._Suffixes(data, begin, np.full(500, 100), np.arange(500))
    group = np.repeat(np.arange(50), 10)
    order = s.sort(group)
    for g in range(50):
        own = order[g * 10 : g * 10 + 10].tolist()
        assert own == sorted(range(g * 10, g * 10 + 10), key=lambda i: (data[begin[i] : begin[i] + 100].tobytes(), i))


def test_sentence_runs(spark):
    a = "The first sentence has quite a few words in it today. A second one follows it right here and goes on a bit. And a third one ends the whole passage that repeats in other documents."
    own = "Something else entirely stands in this place, and only here."
    rows = [(1, f"{own} {a} Tail of one."), (2, f"Head of two! {a}"), (3, f"{a} {a}"), (4, "A second one follows it right here and goes on a bit."), (5, None)]
    got = {r.doc_id: r for r in sentence_spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text == "Head of two!"
    assert got[3].text == ""
    assert got[4].n_removed == 0  # one sentence is no run
    assert got[5].text is None and got[5].n_sentences == 0


def _runs(words):
    """Sentences as lists of words, with the rule for white-space-free marks only."""
    out, own = [], []
    for w in words:
        own.append(w)
        if w[-1] in ".!?":
            out.append(own)
            own = []
    return out + ([own] if own else [])


def test_sentence_runs_against_brute_force(some_docs, monkeypatch):
    monkeypatch.setattr(sentence_spans, "CLAUSE", 1 << 40)  # leave out the clauses that hashes choose
    rows = sorted((r.doc_id, r.text) for r in some_docs.filter("text NOT LIKE '%same same%'").collect())
    seen, want = {}, {}
    for key, text in rows:
        parts, at = _runs(text.lower().split()), set()
        for i in range(len(parts)):
            j = i + 3
            while j <= len(parts) and sum(map(len, parts[i:j])) < 25:
                j += 1
            if j > len(parts):
                continue
            run = tuple(w for p in parts[i:j] for w in p)
            if run in seen:
                at |= set(range(i, j))
            seen[run] = 1
        want[key] = (len(parts), len(at))
    docs = some_docs.filter("text NOT LIKE '%same same%'")
    chunk = [sentence_spans.Sentences(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t in rows]
    assert [len(c.doc) for c in chunk] == [want[k][0] for k, _ in rows]
    del docs
    first = {}
    for (key, _), c in zip(rows, chunk):
        cut = set()
        for i, h in zip(c.runs.tolist(), c.h.tolist()):
            if h in first:
                cut |= set(range(i, int(c.to[i]) + 1))
            first[h] = 1
        assert (len(c.doc), len(cut)) == want[key]


def test_the_query_matches_brute_force(some_docs):
    """Every row of deduplicated(), with the sentence bounds given: first runs by key and place, their words compared as they stand."""
    docs = some_docs.filter("doc_id % 4 <> 1").unionByName(some_docs.filter("doc_id < 8").withColumn("doc_id", F.col("doc_id") + 500))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    seen, want = set(), {}
    for key, text in rows:
        raw = text.encode()
        s = sentence_spans.Sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        spans = [raw[a:b] for a, b in zip(s.start.tolist(), s.end.tolist())]
        cut = [False] * len(spans)
        for i in range(len(spans)):
            j, words = i, []
            while j < len(spans) and (j - i < sentence_spans.RUN or len(words) < sentence_spans.RUN_WORDS):
                words += spans[j].lower().split()
                j += 1
            if j - i < sentence_spans.RUN or len(words) < sentence_spans.RUN_WORDS:
                break
            if tuple(words) in seen:
                cut[i:j] = [True] * (j - i)
            seen.add(tuple(words))
        kept = b"".join(raw[(int(s.end[i - 1]) if i else 0) : int(s.end[i])] for i in range(len(spans)) if not cut[i]) + (raw[int(s.end[-1]) :] if spans else raw)
        kept = kept.decode()
        want[key] = (len(spans), sum(cut), kept.lstrip() if spans and cut[0] else kept)
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentence_spans.deduplicated(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 50


@pytest.mark.parametrize("mark", ["", "."])
def test_each_shared_passage_of_51_words_holds_a_run(mark):
    """Passages in other contexts, without marks and with a mark after every seventeenth word."""
    rng = np.random.default_rng(6)

    def words(n):
        return [f"w{x}" + (mark if i % 17 == 16 else "") for i, x in enumerate(rng.integers(0, 3000, n))]

    for _ in range(300):
        passage = words(51)
        found = []
        for _ in range(2):
            data = " ".join([*words(int(rng.integers(0, 60))), *passage, *words(int(rng.integers(0, 60)))]).encode()
            found.append(set(sentence_spans.Sentences(np.frombuffer(data, np.uint8), np.array([0, len(data)])).h.tolist()))
        assert found[0] & found[1]
