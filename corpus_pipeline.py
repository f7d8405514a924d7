"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, packing.

Every stage works on all rows that the one before kept and returns the columns
of documents; the last returns the pieces of the packed sequences. Null and
empty texts pass the filters and are packed as one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveglass.llm import decontamination, packing, secret_forest, simhash, toxicity
from sieveglass.llm.common import crc_mod, remove, table, table_folder


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go; a null text scores like an empty one."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, similarity 0.8) the row with the smallest id stays; rows without an id stay."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by a marker; every row stays."""
    path = F.concat_ws("/", F.col("source").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = secret_forest.redact(docs, secret_forest.train(_vocabulary()), _vocabulary(), path=path)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.contains("text", F.lit(secret_forest.MARKER)), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, sources in their own proportions."""
    return packing.packed(docs, _vocabulary())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_benchmark), ("secrets", redact_secrets), ("packing", pack)]
#: The stages are models, alignments and a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep; each stage's rows are a table in the shared folder until the next one has read them."""
    docs, at = table(spark, sf_dir, "documents"), table_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
    pieces = STAGES[-1][1](spark, docs, sf_dir)  # from checkpoints: the documents aren't read again
    remove(spark, at)
    return pieces
