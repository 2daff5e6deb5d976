"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, decontaminate, html_extract, mixing, quality, sentence_spans, sharding, simhash, suffix_dedup, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights: by domain, then language within it, then source within that; others weigh 1.
WEIGHTS: dict[tuple[str | None, ...], float] = {("web",): 3.0, ("books",): 2.0, ("code",): 1.0, ("web", "en"): 2.0, ("books", "en"): 2.0, ("code", "en"): 4.0}
DOMAINS = ("web", "books", "code")


def leaf_path() -> list[Column]:
    """domain, lang, source: sources belong to domains by the number that ends their name."""
    number = F.regexp_extract("source", r"(\d{1,9})$", 1)
    domain = F.when(number != "", F.element_at(F.array(*map(F.lit, DOMAINS)), number.cast("int") % len(DOMAINS) + 1))
    return [domain, F.col("lang"), F.col("source")]


def tokens_in(text: str = "text") -> Column:
    """Tokens of a row, as the mix counts them: about four bytes each."""
    return F.floor((F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 3) / 4)


MIX = mixing.Mix(WEIGHTS, share=0.8, epochs=2, seed=11)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = _table(spark, sf_dir, "benchmark")
    return decontaminate.report(docs, bench).drop("text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    out = toxicity.report(docs, model)
    model.discard()  # the tables of its last block are broadcast by now
    return out


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    files = token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(files, path)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.train(docs, labels)).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tokens = tokens_in()
    picked = mixing.select(docs.select("doc_id", "lang", "source", tokens.alias("n_tokens")), MIX, leaf_path(), F.col("n_tokens"))
    return picked.select("doc_id", "lang", "source", "n_tokens", "epoch")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_decontaminate": op2_decontaminate,
        "op3_simhash": op3_simhash,
        "op4_sentence_spans": op4_sentence_spans,
        "op5_toxicity": op5_toxicity,
        "op6_token_files": op6_token_files,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_html": op9_html,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} FROM documents),
b AS (SELECT item_id, {_WORDS} FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g FROM (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS j FROM b WHERE len(w) > 0) x),
dw AS (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) k WHERE len(w) >= n) x),
hit AS (SELECT doc_id, j, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(j, j + n - 1)) AS p FROM hit) x GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) x GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The others train, hash or tokenise in ways that SQL does not have; tests hold them against brute force."""
    return {"op2_decontaminate": OP2_SQL}
