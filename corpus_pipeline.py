"""A training corpus from raw documents, in five stages. Each stage is one operator of docweave.llm; what it returns is written as Parquet
and read again as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, minhash, mixing, quality, toxicity
from docweave.llm.common import spool, table, unspool


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts score like the empty text and stay; texts of any length are read whole; equal texts share their fate, so repeated rows all stay or
    all go; other columns are handed through whatever their names; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts are judged as empty ones; texts of any length are read whole; equal texts share their fate; other columns are handed through; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id. Near-duplicates share 80 % of their five-word shingles.

    Null, empty and blank texts are like nothing and stay, rows without doc_id stay, rows that repeat a kept doc_id all stay; other columns are handed through; an empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs, 5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in the shuffled order; a document that is drawn twice has two rows.

    A null source is a source of its own; null and blank texts have no words and are never drawn; repeated rows are drawn alike; columns named mix_shard or
    mix_place are lost, all others are handed through; an empty table stays empty.
    """
    return mixing.shuffled(mixing.mix(docs)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of every row, in the order of the rows.

    Null and empty texts have no ids (an empty list, 0 tokens); texts of any length are encoded whole; repeated rows are encoded each; an empty table stays empty.
    """
    ids = bpe.encode_documents(docs.select("doc_id", "source", "text"), drop=("text",))
    return ids.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", not_toxic),
    ("quality classifier", of_quality),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding", encoded),
]

#: No SQL has the classifiers, the signatures or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents``. Each stage's rows are written to the shared folder and read again; what no stage reads any more is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), "pipeline")
        if last is not None:
            unspool(last)
        last = docs
    return docs
