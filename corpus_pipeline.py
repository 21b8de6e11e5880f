"""A corpus pipeline of five stages over ``documents``.

Each stage takes what the one before kept; all but the last return the columns
of documents.  Language ID, SimHash clusters and BPE are not SQL, so there is no
ORACLE_SQL; tests/llm holds the stages against brute force.

Null texts are in no language and go in the first stage, as do empty ones.  Very
long texts pass whole.  Of repeated rows and ties the near-duplicate stage keeps
one, by id, then text hash.  Extra columns pass through every stage but the
last, whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflow.llm import bpe, langid, mixing, secrets, simhash
from cartoflow.llm.common import documents, map_texts, written

#: A document whose language is less sure than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, of an unsure one, or unlike the texts of all that were learnt go; a missing label is filled in."""
    return langid.accepted(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced in the texts, widely copied placeholders aside; every document stays, its n_chars is counted anew."""
    out = secrets.redact_rows(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""

    def run(texts: list[str | None]) -> list[tuple]:
        own = bpe.codec(None)
        return [(len(ids), ids, own.decode(ids) == (text or "").encode()) for text, ids in zip(texts, own.encode([x or "" for x in texts]), strict=True)]

    return map_texts(docs, run, "n_tokens long, ids array<int>, round_trip boolean", limit=bpe.BATCH_CHARS)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("secret_scan", redact_secrets), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
