"""Importance resampling towards a target text distribution.

Lower-cased word 1- and 2-grams are hashed into a fixed number of buckets.  Bucket frequencies over all target texts and over
all texts are two generative models; a document's log weight is the log of their ratio over its n-grams.  Adding
Gumbel noise and keeping the k largest keys samples k documents without replacement in proportion to their weights.

The k-th key is found by counting, 16 bits of the key's order at a time, so nothing is sorted as a whole.  Noise is a hash
of document id and seed: reruns agree.

Edge cases: null or empty text has log weight 0; equal keys are resolved by id; repeated rows have equal keys and
are kept or not one by one until k rows are reached; with no target text all weights are 0 and the sample is
uniform; extra columns are ignored; an empty table gives an empty sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.llm import common
from winnower.llm.jaccard_join import _pack, _sum_pieces, _unpack

BUCKETS = 10_000


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word 1-gram and 2-gram."""
    starts, ends, first = common.words_of(data, offsets)
    h = common.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = common.windows_of(h, 2)
    inside = np.flatnonzero(row[1:] == row[:-1])
    rows = np.concatenate([row, row[inside]])
    return rows, (np.concatenate([h, pair[inside] if len(pair) else pair]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, target: str, buckets: int = BUCKETS, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """n-grams per bucket over all rows, and over the rows where the boolean column ``target`` is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            chosen = np.array(batch.column(1).fill_null(False).to_pylist(), bool)
            for at, to, data, offsets in common.text_chunks(batch.column(0)):
                row, slot = gram_buckets(data, offsets, buckets)
                total[0] += np.bincount(slot, minlength=buckets)
                total[1] += np.bincount(slot[chosen[at:to][row]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([_pack(t) for t in total], pa.binary())], names=["piece", "counts"])

    kind = "piece int, counts binary"
    parts = docs.select(F.col(text).cast("string"), F.col(target)).mapInArrow(count, kind)
    parts = parts.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(64))).repartition(64, "piece", "_s").drop("_s").mapInArrow(_sum_pieces, kind)
    out = [np.zeros(buckets), np.zeros(buckets)]
    for r in parts.repartition(2, "piece").mapInArrow(_sum_pieces, kind).collect():
        out[r["piece"]] += _unpack(bytes(r["counts"]))
    return out[0], out[1]


def log_weights(docs: DataFrame, raw: np.ndarray, goal: np.ndarray, seed: int = 7, smooth: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_grams, log_weight, gumbel_key, order_key``; ``order_key`` sorts as ``gumbel_key`` does."""
    buckets = len(raw)
    if goal.sum():
        ratio = np.log((goal + smooth) / (goal.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))
    else:
        ratio = np.zeros(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            noise = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            for at, to, data, offsets in common.text_chunks(batch.column(1)):
                row, slot = gram_buckets(data, offsets, buckets)
                n = np.bincount(row, minlength=to - at)
                weight = np.bincount(row, weights=ratio[slot], minlength=to - at)
                key = weight - np.log(-np.log((noise[at:to] + 0.5) / (1 << 52)))
                bits = (key + 0.0).view(np.int64)
                bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(weight), pa.array(key), pa.array(bits)],
                    names=["doc_id", "n_grams", "log_weight", "gumbel_key", "order_key"],
                )

    uniform = F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("long"), F.lit(seed).cast("long")), 12)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), uniform.alias("u"))
    return given.mapInArrow(run, "doc_id long, n_grams long, log_weight double, gumbel_key double, order_key long")


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(the k-th largest value of a long column, how many of the rows with that value are among the k).

    Four counting passes of at most 65536 groups each.
    """
    low, high = -(1 << 63), (1 << 63) - 1
    need = k
    for shift in (48, 32, 16, 0):
        level = rows.where(F.col(column).between(low, high)).groupBy(F.shiftright(column, shift).alias("b")).agg(F.count("*").alias("n"))
        for r in sorted(level.collect(), key=lambda r: -r["b"]):
            if need <= r["n"]:
                low, high = r["b"] << shift, (r["b"] << shift) + (1 << shift) - 1
                break
            need -= r["n"]
    return low, need


def resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.85, seed: int = 7, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """``doc_id, n_grams, log_weight, gumbel_key, selected``: round(share * rows) rows are selected.

    ``target_ids`` (``doc_id``) names the target documents; the list is broadcast only up to ``broadcast_rows`` ids.
    """
    ids = common.spool(target_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct(), "targets")
    few = ids.count() <= broadcast_rows
    marked = ids.withColumn("_target", F.lit(True))
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))
    both = texts.join(F.broadcast(marked) if few else marked, F.col("_doc") == F.col("_id"), "left")
    raw, goal = bucket_counts(both, "_target")
    keyed = common.spool(log_weights(docs, raw, goal, seed, doc_id=doc_id, text=text), "weights")
    n = keyed.count()
    k = round(share * n)
    if not k:
        return keyed.select("doc_id", "n_grams", "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    value, ties = kth_largest(keyed, "order_key", k)
    # equal keys are equal rows of one id, or a chance hit: few, ranked by id
    edge = keyed.where(F.col("order_key") == value).withColumn("_r", F.row_number().over(Window.partitionBy("order_key").orderBy("doc_id", "n_grams")))
    sure = keyed.where(F.col("order_key") != value).withColumn("selected", F.col("order_key") > value)
    out = sure.unionByName(edge.withColumn("selected", F.col("_r") <= ties).drop("_r"))
    return out.select("doc_id", "n_grams", "log_weight", "gumbel_key", "selected")
