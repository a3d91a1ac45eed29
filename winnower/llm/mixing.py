"""Mixing sources to target weights.

Words of a source, its documents laid end to end in a pseudorandom order, are cut into blocks of fixed length.  Every
output shard draws how many of its slots each source gets from a multinomial; the n-th slot a source gets takes the
block at place n of a pseudorandom permutation of the source's blocks (a fresh permutation for every pass), and slots
meet blocks in a join by (source, block).

The multinomial draws are conditioned on each source's total over all shards, so shards vary but totals meet the
targets.  Everything depends only on the data and ``seed``: reruns agree.

Only one row per source comes to the driver (its size), at most ``max_sources``; beyond that an error says so.

Edge cases: null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last;
repeated rows of one id are separate documents, told apart by their texts and then by number; a null id is an id like any
other; extra columns are ignored; an empty table gives an empty mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from winnower.llm import common

BLOCK = 64
MAX_REPEATS = 3


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, own, source, size``: words of each document; ``own`` tells texts of one id apart."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)).cast("long"), F.lit(0).cast("long"))
    own = F.xxhash64(F.col(text).cast("string")).alias("own")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), own, F.col(source).cast("string").alias("source"), n.alias("size"))


def code_point_order(names: list[str | None]) -> list[str | None]:
    """Names by code point, null last."""
    return sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in names)


def targets(amounts: list[float], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Share the sum of ``amounts`` by weight, none above ``most`` times its own amount.

    The excess over a cap is shared again by weight among the others, until none is above.
    """
    total, result, open_ = float(sum(amounts)), [0.0] * len(amounts), set(range(len(amounts)))
    rest = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / weight > most * amounts[i]}
        if not over:
            for i in open_:
                result[i] = rest * weights[i] / weight
            break
        for i in over:
            result[i] = float(most * amounts[i])
            rest -= result[i]
        open_ -= over
    return result


def draw_counts(totals: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shard, source] slots: multinomial draws from what each source still has to give, exact in total."""
    left = totals.astype(np.int64).copy()
    out = np.zeros((shards, len(totals)), np.int64)
    for k in range(shards):
        slots = -(-int(left.sum()) // (shards - k))
        rng = np.random.default_rng([seed, k])
        while slots and left.sum():
            got = np.minimum(rng.multinomial(slots, left / left.sum()), left)
            out[k] += got
            left -= got
            slots -= int(got.sum())
    return out


def permute(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Block at each place of a keyed pseudorandom permutation of 0..n-1.

    A four-round Feistel network over the smallest even number of bits that holds n, walked until it falls below n
    (the domain is under four times n, so a handful of steps on average).
    """
    place = place.astype(np.uint64)
    bits = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(n, 2))) / 2)).astype(np.uint64)
    half = (np.uint64(1) << bits) - np.uint64(1)

    def once(x: np.ndarray, which: np.ndarray) -> np.ndarray:
        b, m, k = bits[which], half[which], key[which]
        left, right = x >> b, x & m
        for r in range(4):
            left, right = right, left ^ (common.mix(right + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & m)
        return (left << b) | right

    out, todo = place.copy(), np.arange(len(place))
    with np.errstate(over="ignore"):
        while len(todo):
            out[todo] = once(out[todo], todo)
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def slot_blocks(spark, plan: list[dict], counts: np.ndarray, seed: int, per_task: int = 200_000) -> DataFrame:
    """``shard, slot, source_no, epoch, block``: what every slot of every shard holds.

    ``plan`` has for each source its number of blocks.  Slots are made on the executors from ranges; within a shard
    their order is shuffled by a keyed permutation too.
    """
    blocks = np.array([p["blocks"] for p in plan], np.int64)
    per_shard = counts.sum(1)
    first_slot = np.concatenate([[0], np.cumsum(per_shard)])
    given = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, 0)])  # before each shard
    within = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, 1)], 1)
    shared = spark.sparkContext.broadcast((blocks, first_slot, given, within))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first_slot, given, within = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            shard = np.searchsorted(first_slot, at, "right") - 1
            place = at - first_slot[shard]
            source = np.zeros(len(at), np.int64)
            for k in np.unique(shard):
                own = shard == k
                source[own] = np.searchsorted(within[k], place[own], "right") - 1
            n = given[shard, source] + place - within[shard, source]
            epoch = n // blocks[source]
            key = common.mix((np.uint64(seed) * np.uint64(1 << 20) + source.astype(np.uint64)) * np.uint64(64) + epoch.astype(np.uint64))
            block = permute(n % blocks[source], blocks[source], key)
            length = (first_slot[1:] - first_slot[:-1])[shard]
            slot = permute(place, length, common.mix(shard.astype(np.uint64) + np.uint64(seed + 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (shard, slot, source, epoch, block)], names=["shard", "slot", "source_no", "epoch", "block"]
            )

    total = int(first_slot[-1])
    return spark.range(0, total, 1, common.parts_for(total, per_task)).mapInArrow(make, "shard long, slot long, source_no long, epoch long, block long")


def laid_out(sized: DataFrame, rows: int, per_bucket: int = 4096) -> DataFrame:
    """Add ``start``: words before the document in its source, in hash order of documents.

    Prefix sums run within hash buckets of a source and over the small table of bucket sums, so a source with a third
    of all rows is many tasks.
    """
    buckets = common.parts_for(rows, per_bucket)
    sized = sized.withColumn("_h", F.xxhash64("doc_id", "own")).withColumn("_b", F.shiftrightunsigned("_h", 33) % buckets)
    sums = sized.groupBy("source_no", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("source_no").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("source_no", "_b").orderBy("_h", "doc_id", "own", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_start", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return placed.join(sums, ["source_no", "_b"]).withColumn("start", F.col("_start") + F.col("_before")).drop("_h", "_b", "_start", "_before")


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK, shards: int = 64, seed: int = 20, max_sources: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """Returns the mix and the documents' sizes.

    Mix: ``shard, slot, epoch, source_no, doc_id, own, copy, first_word, n_words``: the words of each document that a slot
    takes; ``copy`` numbers rows that share id and text, by source.  Sizes: ``doc_id, own, copy, source, size, source_no,
    source_size, target``.
    Weights repeat over the sources in code-point order.
    """
    spark = docs.sparkSession
    sized = common.spool(sizes(docs), "doc-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = per_source.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
    by_name = {r["source"]: r for r in found}
    names = code_point_order(list(by_name))
    amounts = [by_name[n]["size"] for n in names]
    goal = targets(amounts, [weights[i % len(weights)] for i in range(len(names))])
    plan = [{"source": n, "source_no": i, "source_size": amounts[i], "target": goal[i], "blocks": -(-amounts[i] // block)} for i, n in enumerate(names)]
    kind = T.StructType([
        T.StructField("source", T.StringType()), T.StructField("source_no", T.LongType()),
        T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("blocks", T.LongType()),
    ])
    sources = spark.createDataFrame([tuple(p.values()) for p in plan], kind)
    sized = sized.join(F.broadcast(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "blocks")
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "own").orderBy("source_no")))
    # whole passes take every block; the last pass as many blocks as come nearest to the rest of the target
    totals = np.array([min(MAX_REPEATS * p["blocks"], _blocks_for(p["target"], p["source_size"], p["blocks"])) for p in plan], np.int64)
    shards = max(1, min(shards, int(totals.sum()) // 16 or 1))
    counts = draw_counts(totals, shards, seed) if len(plan) else np.zeros((1, 0), np.int64)
    slots = slot_blocks(spark, plan, counts, seed)
    placed = laid_out(sized.where("size > 0").select("doc_id", "own", "copy", "size", "source_no"), sum(r["n"] for r in found))
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumns({"first_word": begin - F.col("start"), "n_words": end - begin})
    mix = slots.join(pieces, ["source_no", "block"]).select("shard", "slot", "epoch", "source_no", "doc_id", "own", "copy", "first_word", "n_words")
    return mix, sized


def _blocks_for(target: float, size: int, blocks: int) -> int:
    """Blocks whose words come nearest to the target: whole passes, then a share of one."""
    if not size:
        return 0
    passes = int(target // size)
    return passes * blocks + round((target - passes * size) / size * blocks)


def taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: words the mix takes of each document, repeats counted."""
    mix, sized = mix_documents(docs, **options)
    per_doc = mix.groupBy("doc_id", "own", "copy").agg(F.sum("n_words").alias("taken"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), F.col("copy").alias("_copy"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")) & (F.col("copy") == F.col("_copy"))
    out = sized.join(per_doc, same, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WORD = re.compile(common.WORD)


def _cut(text: str, spans: list[dict]) -> str:
    """The words of the spans (first_word, n_words) of one pass; neighbours keep the white space between them."""
    words = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["first_word"]):
        end = s["first_word"] + s["n_words"]
        if runs and runs[-1][1] == s["first_word"]:
            runs[-1][1] = end
        else:
            runs.append([s["first_word"], end])
    if runs == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)


def mixed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix has it: one row for each pass over a document that takes any of its words.

    ``text`` holds the words taken in that pass, with the white space between neighbours as it was; runs that are
    not neighbours are joined by a line break.  Other columns stay.
    """
    mix, _ = mix_documents(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), **options)
    spans = mix.groupBy("doc_id", "own", "copy", "epoch").agg(F.collect_list(F.struct("first_word", "n_words")).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("own").alias("_n"), F.col("copy").alias("_k"), "_spans")
    # one shuffle of the texts, by id and text, serves the numbering of equal rows and the join
    rows = docs.withColumns({"_key": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "_none": F.col(doc_id).cast("long").isNull(), "_own": F.xxhash64(F.col(text).cast("string"))})
    rows = rows.repartition("_key", "_none", "_own")
    same = Window.partitionBy("_key", "_none", "_own").orderBy(F.col(source).asc_nulls_last())
    rows = rows.withColumn("_copy", F.row_number().over(same))
    spans = spans.withColumns({"_id": F.coalesce("_id", F.lit(0)), "_no": F.col("_id").isNull()})
    both = rows.join(spans, F.expr("_key = _id and _none = _no and _own = _n and _copy = _k")).select(*docs.columns, "_spans")
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(docs_columns)).to_pylist())]
            arrays = [batch.column(k) for k in range(len(docs_columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=docs_columns)

    docs_columns = docs.columns
    return both.mapInArrow(cut, docs.schema)
