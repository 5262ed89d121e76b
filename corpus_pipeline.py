"""Text cleaning for training data, as stages over the documents table.

Each stage works on all rows that the one before kept, and drops or changes rows; the last one turns texts to piece ids. A stage's output
is written and read again before the next, so a lost executor costs one stage at most; what a stage wrote on its way is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcast.llm import decontam, line_dedup, near_dup, pieces, quality
from loomcast.llm._sampling import remainder
from loomcast.llm._tables import discard_since, mark, written
from loomcast.llm.queries import PIECE_MODEL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels, remainder(3) != 1))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that came before go, and documents that have nothing else."""
    return line_dedup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group stays; shingles of five words, similarity 0.8."""
    return near_dup.without_copies(docs, words=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the contamination rule finds go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: (doc_id, ids, n_pieces, round_trip)."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [("quality", good_quality), ("line_dedup", repeated_lines), ("near_dedup", near_copies), ("decontamination", benchmark_passages), ("pieces", piece_ids)]

#: Trained models and piece ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        began = mark()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            discard_since(spark, began, keep=docs)
    return docs
