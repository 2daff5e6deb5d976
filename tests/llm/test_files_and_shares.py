"""Token files, sharding and mixing."""

import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import common, mixing, sharding, token_files


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**33, 2**62, 2**64 - 1])
def test_code_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 5, 119, 121, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        ids[rng.random(n) < 0.5] = 0
        words = token_files.encode_block(ids)
        assert (token_files.decode_block(words, n) == ids).all()


def _tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_matches_the_library(odd_docs, some_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(_tokenizer())
    texts = [r.text for r in odd_docs.collect() + some_docs.collect()]
    texts += [" a", "a ", "a  b\n\nc", "it's  <|endoftext|> x", "x\ty z", "don't stop\nNow 'tis 12a3 'll", "x y", "　", "é\nü", "a\x1cb c"]
    encoder = token_files.Encoder.of(_tokenizer())
    for _ in range(2):  # afresh, then from memory
        ids, bounds = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark, some_docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    plain = Tokenizer.from_file(_tokenizer())
    path = f"file://{tmp_path}/tokens"
    files = token_files.write(some_docs, path, _tokenizer(), n_files=3)
    assert files.count() == len(list((tmp_path / "tokens").glob("part-*.s8b")))
    got = sorted(tuple(r) for r in token_files.read(files, path, ids=True).collect())
    at = 0
    for (doc, text), r in zip(sorted((r.doc_id, r.text) for r in some_docs.collect()), got, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert r == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)


def test_shards_are_even_and_keep_copies_together(spark, some_docs):
    docs = some_docs.union(some_docs.withColumn("doc_id", F.col("doc_id") + 1000))
    got = sharding.assign(docs, 7).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    homes, sums, slots = {}, [0] * 7, {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        assert homes.setdefault(raw, r.shard) == r.shard
        sums[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert max(sums) - min(sums) < 0.02 * sum(sums)
    for own in slots.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        assert [d for _, d in sorted(own)] == sorted(d for _, d in own)


@pytest.mark.parametrize("fan", [2, 1000])
def test_blocks_are_combined(spark, some_docs, fan):
    """Groups stay whole, all rows are placed, and shards are even, whether the driver or tasks combine the blocks."""
    docs = some_docs.union(some_docs.withColumn("doc_id", F.col("doc_id") + 1000))
    got = sharding.assign(docs, 7, block_rows=20, fan=fan).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    homes, sums = {}, [0] * 7
    for r in got:
        assert homes.setdefault(texts[r.doc_id], r.shard) == r.shard
        sums[r.shard] += r["size"]
    assert len(got) == len(texts) and max(sums) - min(sums) < 0.1 * sum(sums)
    slots = sorted((r.shard, r.slot) for r in got)
    assert slots == [(s, k) for s in range(7) for k in range(sum(r.shard == s for r in got))]


def _plain_differencing(sizes, parts):
    """The sums of Karmarkar-Karp differencing, step by step on lists."""
    todo = [[n] + [0] * (parts - 1) for n in sizes]
    while len(todo) > 1:
        spread = [x[0] - x[-1] for x in todo]
        a = spread.index(max(spread))
        x = todo.pop(a)
        spread.pop(a)
        y = todo.pop(spread.index(max(spread)))
        todo.append(sorted((p + q for p, q in zip(x, reversed(y))), reverse=True))
    return todo[0]


def test_differencing_step_by_step():
    rng = np.random.default_rng(9)
    for parts in (2, 3, 7):
        sizes = rng.permutation(5000)[:120] + 1
        _, sums = sharding.difference(sizes, parts)
        want = _plain_differencing(sizes.tolist(), parts)
        assert sums.sum() == sum(want) and abs((sums.max() - sums.min()) - (want[0] - want[-1])) <= 40


def test_hashes_of_texts_are_independent(spark):
    """The two halves of a text's hash: the second is not a function of the first."""
    row = sharding._facts(spark.createDataFrame([("abc",)], "text string"), "text").withColumn("chained", F.expr("xxhash64('abc', 'second')")).first()
    assert row._kl_g != row.chained and row._kl_g != row._kl_h


def test_differencing():
    part, sums = sharding.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]
    assert sorted(np.bincount(part, weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 10_000, 5000)
    part, sums = sharding.difference(sizes, 40)
    assert (np.bincount(part, weights=sizes, minlength=40) == sums).all() and sums.max() - sums.min() <= 2
    final, total = sharding.difference(np.array([[10, 4, 0], [9, 9, 0], [3, 2, 1]]), 3)
    assert sorted(map(tuple, map(sorted, final.tolist()))) == [(0, 1, 2)] * 3 and total.sum() == 38


def test_budgets_go_to_siblings_first():
    offers = {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 1000}
    assert mixing.budgets(offers, mixing.Mix({("a",): 1, ("b",): 1}, tokens=1000)) == {("a", "x"): 100, ("a", "y"): 400, ("b", "x"): 500}
    assert mixing.budgets({("a", "x"): 100, ("b", "x"): 1000}, mixing.Mix({}, tokens=1000)) == {("a", "x"): 100, ("b", "x"): 900}
    assert mixing.budgets({("a", "x"): 100, ("b", "x"): 1000}, mixing.Mix({}, tokens=1000, epochs=4)) == {("a", "x"): 400, ("b", "x"): 600}
    assert mixing.budgets({("a",): 5}, mixing.Mix({("a",): 0.0}, tokens=3)) == {("a",): 0}
    assert mixing.budgets({}, mixing.Mix({})) == {}


def test_leaf_prefixes(spark):
    rows = [(i, "a" if i % 2 else "b", None if i % 3 else "s", 1 + i % 5) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long")
    mix = mixing.Mix({("a",): 3.0, ("b",): 1.0}, share=0.9, epochs=2, seed=5)
    got = mixing.select(docs, mix, [F.col("lang"), F.col("source")], F.col("n")).collect()
    offers, took = {}, {}
    for i, lang, source, n in rows:
        offers[lang, source] = offers.get((lang, source), 0) + n
    for r in got:
        took[r.lang, r.source] = took.get((r.lang, r.source), 0) + r.n
    for leaf, budget in mixing.budgets(offers, mix).items():
        assert 0 <= took.get(leaf, 0) - budget < 10  # the row that reaches it, in each of two epochs at most
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    again = mixing.select(docs.repartition(7), mix, [F.col("lang"), F.col("source")], F.col("n")).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def _plain_budgets(offers, weights, budget, prefix=()):
    """Budgets by giving a little at a time to the children that can still take some."""
    children = sorted({p[: len(prefix) + 1] for p in offers if p[: len(prefix)] == prefix})
    if children == [prefix] or not children:
        return {prefix: min(budget, offers[prefix])}
    room = {c: sum(n for p, n in offers.items() if p[: len(c)] == c) for c in children}
    due = dict.fromkeys(children, 0.0)
    left = min(budget, sum(room.values()))
    while left > 1e-9:
        open_ = [c for c in children if due[c] < room[c] - 1e-12]
        total = sum(weights.get(c, 1.0) for c in open_)
        if not open_ or total <= 0:
            break
        part = min(1.0, *[(room[c] - due[c]) / (left * weights.get(c, 1.0) / total) for c in open_ if weights.get(c, 1.0)])
        for c in open_:
            due[c] += part * left * weights.get(c, 1.0) / total
        left = min(budget, sum(room.values())) - sum(due.values())
    out = {}
    for c in children:
        out |= _plain_budgets(offers, weights, due[c], c) if len(c) < len(next(iter(offers))) else {c: due[c]}
    return out


def test_budgets_match_a_plain_version():
    rng = np.random.default_rng(11)
    for _ in range(50):
        offers = {(d, la, s): int(rng.integers(1, 1000)) for d in "ab" for la in "xyz" for s in range(int(rng.integers(1, 5)))}
        weights = {p[:n]: float(rng.integers(1, 5)) for p in offers for n in (1, 2, 3) if rng.random() < 0.5}
        tokens = int(sum(offers.values()) * rng.random())
        got, want = mixing.budgets(offers, mixing.Mix(weights, tokens=tokens)), _plain_budgets(offers, weights, tokens)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.5001 for k in got)


def test_budgets_of_many_leaves_take_no_time():
    offers = {("d", "l", str(i)): 1 + i % 7 for i in range(200_000)}
    began = time.process_time()
    got = mixing.budgets(offers, mixing.Mix({}, share=0.5))
    assert time.process_time() - began < 10 and abs(sum(got.values()) - 0.5 * sum(offers.values())) < 0.2 * len(offers)


@pytest.mark.parametrize("epochs", [1, 3])
def test_the_rows_taken_are_each_leafs_prefix(spark, epochs):
    """Brute force: each epoch's rows in order of the seeded hash, until the budget is reached."""
    rows = [(i // 2 if i % 50 == 0 else i, "abc"[i % 3], None if i % 4 else "s", i % 6, f"t{i}") for i in range(1500)] + [(None, "a", "s", 3, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long, other string")
    mix = mixing.Mix({("a",): 9.0, ("b",): 1.0}, share=0.8, epochs=epochs, seed=3)
    hashes = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    hashes = hashes.withColumn("o", F.xxhash64(F.lit(mix.seed), F.col("epoch"), F.col("doc_id"), F.col("n"))).withColumn("last", F.xxhash64("doc_id", "lang", "source", "n", "other")).collect()
    offers, leaves = {}, {}
    for r in hashes:
        leaves.setdefault((r.lang, r.source), {}).setdefault(r.epoch, []).append(r)
        if r.epoch == 0:
            offers[r.lang, r.source] = offers.get((r.lang, r.source), 0) + r.n
    want = []
    for leaf, budget in mixing.budgets(offers, mix).items():
        for e in range(epochs):
            left = min(budget, offers[leaf])
            whole = left == offers[leaf] > 0  # rows without tokens at its end come along
            budget -= left
            for r in sorted(leaves[leaf][e], key=lambda r: (r.o % 2**64, r.doc_id is not None, r.doc_id or 0, r.last)):
                if left <= 0 and not whole:
                    break
                want.append((r.doc_id, r.lang, r.source, r.n, r.other, e))
                left -= r.n
    got = mixing.select(docs, mix, [F.col("lang"), F.col("source")], F.col("n")).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_written_tables_go_to_the_shared_folder(spark):
    folder = common.shared_dir(spark)
    df = common.written(spark.range(5), "five")
    assert df.count() == 5 and all(f.startswith(folder.removeprefix("file://")) or folder in f for f in (x.replace("file:///", "file:///") for x in df.inputFiles()))
    common.discard(df)
