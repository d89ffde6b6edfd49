"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

`run` writes what each stage returns as Parquet in the shared folder and reads it again as the documents of the next.
All stages but the last return the columns of documents. A stage that hands texts to Python writes its own result, so
that batches are small and the shuffles behind it are gone, whoever runs it. Rows with null ids can't be told apart, so stages that remove
by id let them pass; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm import bpe, decontam, line_dedup, ngram_join, toxicity
from lexframe.llm.kit import keep
from lexframe.llm.queries import pattern, tokenizer


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.5 or more; a null text scores like an empty one. The model learns from the
    labels of the table beside the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep(toxicity.keep_clean(docs, toxicity.train(docs, labels)), "clean")


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat as a whole, then takes repeated chunks of lines out of the texts. A document of which
    nothing is left goes; one that was empty before stays. n_chars follows the text."""
    own = without_copies(docs)
    return keep(line_dedup.rewrite(own, line_dedup.repeated_chunks(own), length_col="n_chars"), "new-lines")


def without_copies(docs: DataFrame) -> DataFrame:
    """Drops the documents with the text of a smaller id, byte for byte; null and empty texts stay. All chunks of such a
    document are repeats, so the same is left of all others, but a one-line chunk of a copy would stay as a stub that no
    later stage can tell from a document."""
    digest = F.sha2("text", 256)
    rows = docs.where("doc_id is not null and text <> ''").select("doc_id", digest.alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    gone = rows.join(firsts, "digest").where("doc_id > first").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("__id")) & (digest == F.col("__digest")), "left_anti")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates. Rows with equal ids go together, if each
    of them has a smaller one in its class."""
    classes = ngram_join.classes(docs, n=5, percent=80)
    gone = classes.groupBy("doc_id").agg(F.max("component_id").alias("last")).where("last < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; rows with equal ids go together."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, text_sha256): digests of the ids and of the bytes that they decode to."""
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs, ranks, pattern())
    return keep(coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("text_sha256")), "bpe-digests")


STAGES = [("toxicity", clean_language), ("line dedup", new_lines), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", unseen), ("byte-level BPE", token_ids)]

#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if not hasattr(docs, "_kept_at"):  # written by the stage itself
            docs = keep(docs, name.replace(" ", "-"))
    return docs
