"""The registered queries of this subpackage: each operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcast.llm import decontam, langid, licenses, line_dedup, media, near_dup, pieces, pii, quality, toxicity
from loomcast.llm._sampling import remainder

#: A parameter: where the piece vocabulary is. The file is read by the driver alone.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, remainder(3) != 1)
    return _judged(quality.score(docs, model), remainder(3) == 1)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(_read(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_read(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_read(spark, sf_dir, "documents"), keep_media=False)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder(5) != 0)
    return _judged(toxicity.score(docs, model), remainder(5) == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(4) != 2)
    return langid.predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), PIECE_MODEL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_minhash_near_dedup, op3_personal_data, op4_license_scan, op5_line_dedup, op6_media_columns, op7_benchmark_decontamination, op8_toxicity, op9_language_id, op10_sentencepiece_codec)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": near_dup.ORACLE_SQL, "op3_personal_data": pii.ORACLE_SQL, "op4_license_scan": licenses.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op7_benchmark_decontamination": decontam.ORACLE_SQL}
