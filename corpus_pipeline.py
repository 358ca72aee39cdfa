"""A corpus pipeline of five operators: each stage's rows are written as Parquet and reread as the next stage's documents.

run(spark, sf_dir) gives the encoded mix. A null text counts as empty, a null doc_id comes after all others, a null source is a
source of its own. Of rows alike in text, repeated rows among them, exact dedup keeps one. Empty tables pass as empty tables;
columns beside those of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, exact_dedup, minhash_dedup, mixing, toxicity
from quire.llm.common import table, written
from quire.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold."""
    return toxicity.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.kept_documents(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more the one with the smallest doc_id stays."""
    return minhash_dedup.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document of the mix."""
    return bpe.encoded(docs, tokenizer_file("word_bpe_49k.json"), ("ids", "ids_sha256", "decoded_sha256"), cache=CACHE, block=BLOCK)


CACHE, BLOCK = 150_000, 1_000_000  # words and bytes: an executor's heap has grown by the last stage, so its Python workers get less

STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("bpe", encode)]

#: SQL can't express the classifier or the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
