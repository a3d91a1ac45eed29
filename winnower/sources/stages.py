"""Stages that resume: checkpoints named by their inputs, caches, poison records, saved artefacts and sessions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.sources.sinks import canonical_json, fingerprint, table_digest


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.exists(where))


def publish(df: DataFrame, path: str) -> None:
    """Write beside the path and rename: readers see all of the table or none of it; an existing one is never touched."""
    spark = df.sparkSession
    fs, where = _fs(spark, path)
    if fs.exists(where):
        raise FileExistsError(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".part")
    fs.delete(part, True)
    df.write.parquet(part.toString())
    if not fs.rename(part, where):
        raise OSError(f"can't publish {path}")


def signature(inputs: DataFrame, config: dict[str, Any]) -> str:
    """What a stage's result depends on: the rows it reads, whatever their order, and its configuration."""
    return fingerprint({"input": table_digest(inputs), "config": fingerprint(config)})


def stage(inputs: DataFrame, config: dict[str, Any], folder: str, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's stored result, computed only if none has its signature; another signature starts afresh beside it."""
    spark = inputs.sparkSession
    path = f"{folder}/{name}-{signature(inputs, config)[:32]}"
    if not exists(spark, path):
        publish(work(inputs), path)
    return spark.read.parquet(path)


def resume(pending: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows that no completed chunk holds."""
    return pending.join(done.select(key).distinct(), key, "left_anti")


def cache_store(spark: SparkSession, folder: str, rows: DataFrame, key: str) -> None:
    """Append rows whose key the cache does not hold yet, the least of several rows of one key."""
    fresh = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_v")).select(key, "_v.*").select(*rows.columns)
    if exists(spark, folder):
        fresh = fresh.join(spark.read.parquet(folder).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(folder)


def cache_fetch(spark: SparkSession, folder: str, keys: DataFrame, key: str, valid: str = "true") -> tuple[DataFrame, DataFrame]:
    """(cached rows that ``valid`` accepts, keys to compute): rows that fail the check count as absent."""
    if not exists(spark, folder):
        return keys.limit(0), keys
    hits = spark.read.parquet(folder).where(valid)
    return keys.join(hits, key), keys.join(hits.select(key), key, "left_anti")


def isolated(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, record_id: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(results, rejected ``record_id, error``): a batch that fails is halved until the rows at fault are alone.

    One pass: results and rejects come from the same stage and are told apart by ``error``.
    """
    names = [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]

    def attempt(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield work(frame)[names].assign(_bad=None, _error=None)
        except Exception as problem:  # the row's own failure is the result here
            if len(frame) <= least:
                gone = pd.DataFrame({n: [None] * len(frame) for n in names})
                yield gone.assign(_bad=frame[record_id].to_numpy(), _error=f"{type(problem).__name__}: {problem}")
                return
            half = len(frame) // 2
            yield from attempt(frame.iloc[:half])
            yield from attempt(frame.iloc[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from attempt(frame)

    out = df.mapInPandas(run, f"{schema}, _bad {dict(df.dtypes)[record_id]}, _error string")
    return out.where("_error is null").drop("_bad", "_error"), out.where("_error is not null").select(F.col("_bad").alias(record_id), F.col("_error").alias("error"))


def next_chunk(rows: int, seconds: float, crashed: bool = False, least: int = 25, most: int = 2000) -> int:
    """Rows of the next batch: half after a crash or five slow seconds, half as many again under a quarter of a second."""
    rows = rows // 2 if crashed or seconds > 5 else rows * 3 // 2 if seconds < 0.25 else rows
    return min(most, max(least, rows))


# ---- declarative artefacts as JSON text


def save_artefact(spark: SparkSession, path: str, kind: str, value: dict[str, Any], version: str = "1") -> str:
    """A preset, recipe, profile or study with its kind, version and digest; returns the digest."""
    body = {"kind": kind, "version": version, "value": value}
    digest = fingerprint(body)
    spark.createDataFrame([(canonical_json(body | {"digest": digest}),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return digest


def load_artefact(spark: SparkSession, path: str, kind: str, versions: tuple[str, ...] = ("1",), most_bytes: int = 16 << 20) -> dict[str, Any]:
    """The value, if kind and version are known and the digest is that of the content; larger files are refused."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{path}: {size} bytes are too many")
    body = json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first()[0])
    digest = body.pop("digest", None)
    if body.get("kind") != kind or body.get("version") not in versions:
        raise ValueError(f"{path}: not a {kind} of version {versions}")
    if digest != fingerprint(body):
        raise ValueError(f"{path}: content and digest differ")
    return body["value"]


def replayed(value: dict[str, Any], run: Callable[[dict[str, Any]], DataFrame]) -> DataFrame:
    """The result of running a saved study again; an error if its digest is not the saved one."""
    out = run(value["study"])
    if table_digest(out) != value["digest"]:
        raise ValueError("the study no longer gives the saved result")
    return out


def index_metadata(spark: SparkSession, folder: str, versions: tuple[str, ...] = ("1",)) -> dict[str, Any]:
    """Provenance of an evidence index; other schema versions are refused."""
    meta = load_artefact(spark, f"{folder}/_about", "evidence_index", versions)
    return meta


def scan_measurements(df: DataFrame, target: str, endpoint: str, most: int = 250_000, qualities: tuple[str, ...] = ("high",)) -> DataFrame:
    """Measurements of one target and endpoint with a single endpoint and a wanted quality; none, or over ``most``, is an error."""
    out = df.where((F.col("target_id") == target) & (F.col("endpoint") == endpoint) & ~F.coalesce(F.col("mixed_endpoint"), F.lit(False)) & F.col("quality").isin(list(qualities)))
    n = out.limit(most + 1).count()
    if not n or n > most:
        raise ValueError("no measurements" if not n else f"more than {most} measurements")
    return out


def engine_profile(value: dict[str, Any]) -> dict[str, Any]:
    """A docking engine's profile: elements it knows and thresholds of its flags; a missing field is an error."""
    missing = [k for k in ("id", "name", "version", "common_elements", "flags") if k not in value]
    missing += [f"flags.{k}" for f in value.get("flags", []) for k in ("id", "severity", "threshold") if k not in f]
    if missing:
        raise ValueError(f"profile without {sorted(set(missing))}")
    return {"id": value["id"], "elements": frozenset(value["common_elements"]), "thresholds": {f["id"]: f["threshold"] for f in value["flags"]}}


# ---- sessions


def save_session(folder: str, tables: dict[str, DataFrame], settings: dict[str, Any]) -> dict[str, str]:
    """Every table with its digest, and the settings; returns the digests.  Types, NaN, NULL and infinities stay as they are."""
    spark = next(iter(tables.values())).sparkSession
    digests = {}
    for name, df in tables.items():
        publish(df, f"{folder}/{name}")
        digests[name] = table_digest(spark.read.parquet(f"{folder}/{name}"))
    save_artefact(spark, f"{folder}/_session", "session", {"digests": digests, "settings": settings})
    return digests


def restore_session(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Tables and settings; a table that is not the one saved is an error."""
    about = load_artefact(spark, f"{folder}/_session", "session")
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in about["digests"]}
    changed = [name for name, df in tables.items() if table_digest(df) != about["digests"][name]]
    if changed:
        raise ValueError(f"changed since they were saved: {changed}")
    return tables, about["settings"]


# ---- sealed decisions


def seal(folder: str, snapshot: DataFrame, settings: dict[str, Any], run: Callable[[DataFrame, dict[str, Any]], DataFrame]) -> dict[str, Any]:
    """A proposal that can't be changed unnoticed: the rows decided on, the settings, the decision, and their digests."""
    spark = snapshot.sparkSession
    publish(snapshot, f"{folder}/snapshot")
    publish(run(spark.read.parquet(f"{folder}/snapshot"), settings), f"{folder}/decision")
    about = {"settings": settings, "snapshot": table_digest(spark.read.parquet(f"{folder}/snapshot")), "decision": table_digest(spark.read.parquet(f"{folder}/decision"))}
    save_artefact(spark, f"{folder}/_seal", "proposal", about)
    return about


def verify(spark: SparkSession, folder: str, run: Callable[[DataFrame, dict[str, Any]], DataFrame]) -> DataFrame:
    """The sealed decision; an error unless rows and decision are those sealed and running it again gives the same."""
    about = load_artefact(spark, f"{folder}/_seal", "proposal")
    snapshot, decision = spark.read.parquet(f"{folder}/snapshot"), spark.read.parquet(f"{folder}/decision")
    if table_digest(snapshot) != about["snapshot"] or table_digest(decision) != about["decision"]:
        raise ValueError("the proposal was changed")
    if table_digest(run(snapshot, about["settings"]).select(*decision.columns)) != about["decision"]:
        raise ValueError("the proposal can't be reproduced")
    return decision
