"""A corpus cleaned and encoded in five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark items go, secrets
are masked, and what is left is encoded. Every stage but the last returns the columns it was given.
SQL cannot express the first stage (a trained classifier) nor the last, so there is no SQL twin; tests
compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avalista.llm import bpe, contamination, near_dups, secrets, toxicity
from avalista.llm.common import table
from avalista.llm.queries import public_tokenizer
from avalista.session import scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches the threshold of their language."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.filter(~F.col(scored.columns[-1])).select(*docs.columns)  # its verdict is the last column, whatever the input's names


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return near_dups.without_duplicates(docs, words=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, lang, source, n_chars, n_tokens, ids (packed 32-bit numbers) and their digest."""
    encoded = bpe.encode_documents(docs, public_tokenizer(), keep=("doc_id", "lang", "source", "n_chars"))
    return encoded.select(
        "doc_id", "lang", "source", "n_chars", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
