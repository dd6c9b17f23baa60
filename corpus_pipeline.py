"""Corpus pipeline: quality filter, exact dedup, near-duplicate classes, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents.

* quality: trains the classifier on the labels in sf_dir (outside its held-out
  fold) over the documents at hand and drops every document that it rejects.
* exact_dedup: of equal texts the row with the largest doc_id stays.
* near_duplicates: one document of each class of similar 5-word shingle sets
  (Jaccard 0.8) stays, the one with the smallest doc_id.
* mixing: each document appears as often as the mix takes it, in the order of
  the training positions; documents that the mix leaves out go.
* tokens: ids of every document, verified against the original library.

Null and empty texts pass the quality filter or not by their score, become one
group in exact dedup, and are never taken by the mix. Columns beyond those of
documents are carried along up to the last stage. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import curriculum_mix, exact_dedup, ngram_join, quality_gam, sentencepiece_codec
from ticketlens.llm.queries import PIECE_MODEL
from ticketlens.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Shingle size and similarity of the stage near_duplicates; the query op6 has its own.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_gam.train(docs, labels, learn_from=~quality_gam.held_out("id"))
    return quality_gam.accepted(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_class(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum_mix.in_training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(docs, PIECE_MODEL)
    return coded.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"), "parity")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("exact_dedup", exact_copies), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: Trained scores and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
