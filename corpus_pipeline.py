"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each result as
Parquet into the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import decontaminate, linededup, quality, sentencepiece_scan, simhash
from trackweave.llm.common import discard, materialize, spent, table
from trackweave.llm.queries import PIECES, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least ten documents stay in the first of them only; n_chars is that of the text that is left."""
    rows = linededup.dedup_lines(docs, keep="first", lines_col="__tw_lines", dropped_col="__tw_dropped")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are at least 0.8 similar, directly or in a chain, the smallest id stays."""
    return simhash.dedup_similar(docs, words=5, threshold=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and the decoded text's length."""
    rows = sentencepiece_scan.encode(docs.select("doc_id", "text"), vocabulary(PIECES), decoded_col="decoded")
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.length("decoded").cast("long").alias("n_chars"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: The classifier and the similarity groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents: doc_id, ids, n_pieces, n_chars of those that stay.

    Each stage's result is a table of its own in the shared folder; what a stage made besides, and the result of the
    stage before it, are removed once it is written. An empty table of documents gives an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with spent(spark) as leave:
            docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}")
            leave(docs)
        discard(before)
    return docs
