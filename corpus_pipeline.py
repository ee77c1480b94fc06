"""Stages that make a training corpus of the table documents.

Each function takes (spark, docs, sf_dir); its result, written as Parquet and read again, is the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import bpe, exact_dedup, gam, minmax, mixing
from tagweave.llm.common import bounded, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table labels, accepts.

    Null and empty texts get the score of an empty text; repeated rows are judged alike and stay together; null ids are
    judged by their texts. No rows give no rows; further columns keep their values, whatever their names."""
    return gam.accepted(docs, gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts: the one with the largest doc_id.

    Null and empty texts are equal; a null id is below all others; of rows equal in text and id just one stays. No rows give
    no rows; further columns are those of the row that stays."""
    return exact_dedup.distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Null and empty texts have no shingles and stay; so do rows without an id. Rows that share a doc_id are one document with
    all its texts, so they stay or go together. No rows give no rows; further columns keep their values."""
    gone = written(minmax.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(bounded(gone, minmax.IDS), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; a source's last one may give its first words only.

    Null and empty texts have no words and are never taken; a null source is one of its own, after all others; rows with the
    same id stay apart, and ties of the random key are told by id and size. No rows give no rows; further columns keep their
    values."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs but for text, n_tokens and the ids of each text; round_trip tells whether decoding gives the
    text's bytes. A null text is an empty one; repeated rows get equal ids; no rows give no rows."""
    taken = ("text", "n_tokens", "ids", "round_trip")
    others = [c for c in docs.columns if c not in taken]
    rows = docs.select("text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("__sha"), *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)))
    both = bpe.encode_decode(rows)
    own = [F.col(f"__c{i}").alias(c) for i, c in enumerate(others)]
    return both.select(*own, F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2(F.col("decoded"), 256) == F.col("__sha")).alias("round_trip"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", tokens)]

#: A boosted classifier and shards of ids aren't SQL's; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
