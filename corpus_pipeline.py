"""The corpus pipeline: each stage takes what the one before kept and returns documents; the
last returns packed pieces.

Edge cases are those of the operators. Stages act on rows, not on ids: rows with a null id, ids
that several texts share and repeated rows are judged each by their text, and no column of the
documents is written over but text and n_chars. An empty table gives an empty result. Only
rows that a stage rejects go: toxic texts, copies, and texts without a token (never drawn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import mixing, packing, secrets, simhash, toxicity
from docmill.llm._common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return simhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the document stays, n_chars follows."""
    clean = secrets.mask_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them, each once at least, in its order."""
    return mixing.mixed_rows(docs, cover=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
# Trees, XXH64 fingerprints and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
