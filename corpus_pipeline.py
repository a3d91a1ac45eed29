"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

language ID -> line dedup -> n-gram Jaccard join -> mixing sources to target weights -> best-fit packing

A stage's input is a written table, so what earlier stages stored on the way is deleted as the next one begins.  Rows are known
by id and text together: a null or repeated id loses no document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common, jaccard_join, language_id, line_dedup, mixing, packing
from winnower.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its text is no known language's, or the likeliest one's share is below this.
LEAST_SCORE = 0.4
#: Keys that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _stage(f: Stage) -> Stage:
    """Delete what the stages before have stored, and note what this one does."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.tidy(spark, _left)
        _left.clear()
        common.free_shuffles(spark)
        before = set(common.stored())
        out = f(spark, docs, sf_dir)
        _left.extend(p for p in common.stored() if p not in before)
        return out

    return run


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that was learned; ``lang`` becomes the predicted one."""
    model = language_id.train(docs)
    found = language_id.predict(docs, model, extra=[c for c in COLUMNS if c not in ("doc_id", "lang")])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; a document that loses all its words goes."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one of the least id, null last; of equal rows one."""
    docs = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = jaccard_join.jaccard_components(docs.select("_key", "text"), "_key").groupBy("doc_id").agg(F.min("component_id").alias("comp"), F.count("*").alias("n"))
    groups = common.spool(groups.select(F.col("doc_id").alias("_key"), "comp", "n"), "groups")
    rows = docs.select("_key", "doc_id").join(groups, "_key")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")).select("first._key")
    gone = common.spool(groups.join(first, "_key", "left_anti").select("_key"), "groups-gone")
    again = common.spool(groups.where("n > 1").join(gone, "_key", "left_anti").select("_key"), "groups-again")
    small = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if small else gone, "_key", "left_anti")
    if not again.isEmpty():
        more = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
        kept = kept.join(more, "_key", "left_anti").unionByName(kept.join(more, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: a row for each pass over it, holding the words of that pass."""
    return mixing.mixed_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; the ids themselves are stored in the shared folder."""
    common.tidy(spark, _left)
    _left.clear()
    common.free_shuffles(spark)
    _, index, _ = packing.pack_documents(docs, tokenizer_path())
    return index


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A CRF, SimHash, permutations and subword tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.spool(docs, f"stage-{name}")
            if last is not given:
                common.unspool(last)
    return docs
