"""Every operator and stage on odd rows, no rows, and columns with clashing names."""

import pytest

import corpus_pipeline
from keyloom.llm import decontaminate, mixing, quality, queries, sentence_spans, sharding, simhash, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma"), (None, None), (2, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")


def _operators(bench, labels):
    return {
        "sharding": lambda d: sharding.assign(d),
        "decontaminate": lambda d: decontaminate.report(d, bench),
        "decontaminate_spans": lambda d: decontaminate.decontaminated(d, bench, spans=True),
        "simhash": lambda d: simhash.classes(d),
        "near": lambda d: simhash.near_duplicates(d),
        "sentences": lambda d: sentence_spans.deduplicated(d),
        "toxicity": lambda d: toxicity.report(d, toxicity.train(d, labels)),
        "quality": lambda d: quality.judge(d, quality.train(d, labels)),
        "mixing": lambda d: mixing.select(d, mixing.Mix({}, share=1.0), queries.leaf_path(), queries.tokens_in()),
        "suffixes": lambda d: suffix_dedup.deduplicated(d),
    }


@pytest.mark.parametrize("name", sorted(_operators(None, None)))
def test_odd_rows_and_no_rows(odd_docs, no_docs, bench, labels, name):
    run = _operators(bench, labels)[name]
    out = run(odd_docs)
    assert len(set(out.columns)) == len(out.columns)
    lost = 3 if name == "mixing" else 0  # leaves without tokens have nothing to give
    assert out.count() == odd_docs.count() - lost
    assert run(no_docs).count() == 0


def test_nulls_have_defined_results(odd_docs, bench):
    rows = {r.doc_id: r for r in sharding.assign(odd_docs).collect()}
    assert rows[0]["size"] == rows[1]["size"] == 16 and rows[0].text_crc32 == 0 and rows[0].shard == rows[1].shard
    rows = {r.doc_id: r for r in decontaminate.report(odd_docs, bench).collect()}
    assert rows[0].n_words == 0 and not rows[0].contaminated
    rows = {r.doc_id: r for r in simhash.report(odd_docs).collect()}
    assert rows[0].fingerprint == "0" * 16 and rows[1].component_id == 0 and rows[5].component_id == 4
    rows = [r for r in suffix_dedup.deduplicated(odd_docs).collect()]
    by = {r.doc_id: r for r in rows}
    assert by[0].n_bytes == 0 and by[7].n_removed < by[7].n_bytes and by[8].n_removed == by[8].n_bytes
    assert len({r.n_removed for r in rows if r.doc_id == 4}) == 1  # equal rows count as one document


def test_stages_on_odd_and_no_documents(spark, odd_docs, no_docs, labels, bench, tmp_path):
    sf = f"file://{tmp_path}"
    labels.write.parquet(f"{sf}/labels.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.count() <= 2 * docs.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert set(docs.columns) - set(out.columns) <= {"epoch"}, name
    no_docs.write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
