"""Writers: run folders, reports, bundles with checksums, ordered hand-off."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """One text per value: sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(config: dict[str, Any]) -> str:
    """SHA-256 of the whole configuration."""
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def escaped(value: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def write_run(folder: str, tables: dict[str, DataFrame], config: dict[str, Any], overwrite: bool = False) -> None:
    """A folder per run with a Parquet table each and the configuration as ``config``."""
    mode = "overwrite" if overwrite else "errorifexists"
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(k, canonical_json(v)) for k, v in sorted(config.items())], "key string, value string").coalesce(1).write.mode(mode).parquet(f"{folder}/config")
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def read_run(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def register_run(spark: SparkSession, folder: str, tables: list[str]) -> None:
    """The run's tables as views, for free SQL over a run."""
    for t in tables:
        read_run(spark, folder, t).createOrReplaceTempView(t)


def table_digest(df: DataFrame) -> str:
    """Hash of a table's rows whatever their order, and of its schema."""
    own = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.pmod(own, F.lit(1 << 31))).alias("s")).first()
    return hashlib.sha256(canonical_json([df.schema.simpleString(), r["n"], r["x"], r["s"]]).encode()).hexdigest()


def write_bundle(df: DataFrame, folder: str, manifest: dict[str, Any]) -> dict[str, Any]:
    """Table and manifest with the table's digest; an existing bundle is never touched."""
    df.write.mode("errorifexists").parquet(f"{folder}/records")
    full = manifest | {"digest": table_digest(df.sparkSession.read.parquet(f"{folder}/records"))}
    df.sparkSession.createDataFrame([(canonical_json(full),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return full


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, Any]]:
    """Table and manifest; an error if the table is not the one that was written."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest", wholetext=True).first()[0])
    df = spark.read.parquet(f"{folder}/records")
    if table_digest(df) != manifest["digest"]:
        raise ValueError(f"{folder}: the records don't match the manifest")
    return df, manifest


def wide_export(df: DataFrame, profiles: list[str], columns: list[str]) -> DataFrame:
    """Columns with PASS, FAIL or N/A per profile and a final status."""
    verdicts = [F.when(F.col(f"{p}__passed").isNull(), "N/A").when(F.col(f"{p}__passed"), "PASS").otherwise("FAIL").alias(f"{p}_status") for p in profiles]
    final = F.when(F.col("selected"), "SELECTED").when(F.col("exclusion_reasons") == "", "NOT_SELECTED").otherwise("EXCLUDED")
    texts = [escaped(F.col(c)).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in columns]
    return df.select(*texts, *verdicts, final.alias("final_status"))


def write_split(df: DataFrame, folder: str, by: str) -> None:
    """One sub-folder per value of ``by``: failure sheets by code, alert sheets by catalogue."""
    df.write.mode("errorifexists").partitionBy(by).parquet(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """Delimited text with formula-like text escaped."""
    safe = [escaped(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("errorifexists").option("header", True).csv(folder)


def hand_off(df: DataFrame, ids: list[int], structure: str, record_id: str = "record_id") -> DataFrame:
    """Exactly the given ids in order with their structures; an error if one is missing or blank."""
    spark = df.sparkSession
    order = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{record_id} long, _pos long")
    out = df.where(F.col(structure).isNotNull() & (F.trim(structure) != "")).join(F.broadcast(order), record_id).orderBy("_pos")
    found = out.select(record_id).distinct().count()
    if found != len(set(ids)):
        raise ValueError(f"{len(set(ids)) - found} of {len(set(ids))} records have no structure")
    return out.drop("_pos")
