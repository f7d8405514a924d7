"""Queries of the training-data operators and, where SQL can express one, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, gif, licenses, maxent, packing, quality, rollups, secret_forest, simhash, toxicity
from .common import checkpointed, maybe_in, remove, table


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"))


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.read_back(gif.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.judged(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return got.select("doc_id", "held_out", "score", "predicted", "ll_toxic", "ll_ordinary")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    found = secret_forest.scan(docs, secret_forest.train(words), words, path_col="path")
    return found.select("doc_id", "start", "end", "candidate_sha256", "score", "secret")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no paths: they lie 50 to a directory, whose first one is taken for its licence file
    leaf = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 50).cast("string"))
    upper = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(upper, F.lit("/LICENSE"))).when(F.col("doc_id") % 50 == 0, F.concat(leaf, F.lit("/LICENSE"))).otherwise(F.concat(leaf, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def _batches(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """All documents are inserted; then those labelled toxic are deleted and those of low quality revised; both batches arrive twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    first = docs.select(F.lit("insert").alias("op"), F.lit(1).alias("seq"), "*")
    labels = labels.where("toxic = 1 or quality = 0")
    changed = maybe_in(docs, "doc_id", labels).join(labels, "doc_id")
    op = F.when(F.col("toxic") == 1, "delete").otherwise("revise")
    second = changed.select(op.alias("op"), F.lit(2).alias("seq"), "doc_id", "source", "lang", F.replace("text", F.lit("|"), F.lit(" ")).alias("text"))
    return [("1", first), ("2", second), ("1", first), ("2", second)]


def _rolled_up(spark: SparkSession, sf_dir: str, tokenizers: dict | None) -> DataFrame:
    ledger = rollups.temporary(spark, tokenizers)
    for batch, events in _batches(spark, sf_dir):
        ledger.commit(batch, events)
    totals = checkpointed(ledger.totals())  # a row for each group
    remove(spark, ledger.folder)
    return totals


def vocabularies() -> dict:
    """Tokenizers of op6: words, and two public vocabularies."""
    import public_tokenizers as p

    return {
        ("words", 1): rollups.TOKENIZERS["words", 1],
        ("word_bpe_49k", 1): rollups.Vocabulary("word", p.path("word_bpe_49k.json")),
        ("byte_bpe_50k", 1): rollups.Vocabulary("ranks", p.path("byte_bpe_50k.tiktoken"), p.PATTERN),
    }


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled_up(spark, sf_dir, vocabularies())


def rollup_of_built_in_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's batches with counts that SQL has too, so that SQL can check the rollup."""
    return _rolled_up(spark, sf_dir, None)


OP6_SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, lang, coalesce(CASE WHEN quality = 0 THEN replace(text, '|', ' ') ELSE text END, '') AS text
      FROM documents LEFT JOIN l USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
c AS (SELECT source, lang, 'words' AS tokenizer, 1 AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM d
      UNION ALL SELECT source, lang, 'bytes4', 1, CAST(ceil(strlen(text) / 4.0) AS BIGINT) FROM d
      UNION ALL SELECT source, lang, 'chars', 1, length(text) FROM d)
SELECT source, lang, tokenizer, CAST(version AS INTEGER) AS version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""


QUERIES = {f.__name__: f for f in (op1_gif, op2_simhash, op3_toxicity, op4_decontamination, op5_licenses, op6_token_counts, op7_quality, op8_secrets, op9_maxent, op10_packing)}
QUERIES["rollup_of_built_in_counts"] = rollup_of_built_in_counts
ORACLES: dict[str, str] = {"rollup_of_built_in_counts": OP6_SQL}
