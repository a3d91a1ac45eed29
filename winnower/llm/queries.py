"""The queries over this subpackage's operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import jaccard_join, quality_rules, vector_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm import common, language_id

    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_switches")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm.packing import pack_documents

    _, index, _ = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return index.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm.mixing import taken

    return taken(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm import common, toxicity

    docs = _table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", predicted, "n_toxic", "spans")


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm.vector_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))[0]


def op7_quality_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm import common
    from winnower.llm.quality_sampling import resample

    good = _table(spark, sf_dir, "labels").where("quality = 1").where(~common.held_out("doc_id"))
    return resample(_table(spark, sf_dir, "documents"), good.select("doc_id")).withColumn("kept", F.col("selected"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm.quality_rules import apply_rules

    return apply_rules(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnower.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_quality_sampling": op7_quality_sampling,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
}

ORACLE: dict[str, str] = {
    "op4_jaccard_join": jaccard_join.SQL,
    "op6_vector_dedup": vector_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
