"""Best-fit packing of token sequences by bin completion.

What must be decided depends only on how many pieces have each length, at most ``capacity`` numbers whatever the
input's size.  That histogram comes to the driver; a branch-and-bound over it yields *patterns* (a multiset of
lengths and how often it is used), and rows take their places in the patterns by their rank within their length.

Edge cases: null or empty text is one document holding only the end token; a document of exactly ``capacity``
tokens fills a sequence alone; repeated rows (also of one id) are separate documents; extra columns are ignored;
an empty table packs into no sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from winnower.llm import common, wordbpe

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids`` (unsigned little-endian 32-bit ids).

    Each document's ids end with ``end_id``; only those longer than ``capacity`` are cut, into full pieces and a rest.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else None
            keys = batch.column(0).to_pylist() if key is None else key
            for at, to, ids, offsets in wordbpe.encode_column(tokenizer, batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                for k in range(to - at):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        for col, value in zip(out, (keys[at + k], piece, start, len(part), part.tobytes())):
                            col.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECES)


# ---- the search ---------------------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: total length, and Martello-Toth's bound over thresholds up to half."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    weight = np.zeros(capacity + 1, np.int64)
    number = np.zeros(capacity + 1, np.int64)
    for s in sizes:
        weight[s], number[s] = s * counts[s], counts[s]
    w, n = np.cumsum(weight), np.cumsum(number)
    half = capacity // 2
    for k in (s for s in sizes if s <= half):
        alone = n[capacity] - n[capacity - k]
        large = n[capacity - k] - n[half]
        room = large * capacity - (w[capacity - k] - w[half])
        small = w[half] - (w[k - 1] if k else 0)
        best = max(best, int(alone + large + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in descending order, whole runs of like sequences at a time: the first incumbent.

    Sequences with the same free room are kept together with the number of them, so the work follows the number of
    distinct lengths and patterns, not the number of pieces.
    """
    free: dict[int, Counter] = {}
    rooms = np.zeros(capacity + 1, bool)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fit = np.flatnonzero(rooms[size:])
            if len(fit):
                room = int(fit[0]) + size
                pattern, have = next(iter(free[room].items()))
                each = room // size if room - size < size else 1
                each = max(1, min(each, left))
                use = min(have, left // each)
                if have == use:
                    del free[room][pattern]
                    if not free[room]:
                        rooms[room] = False
                else:
                    free[room][pattern] -= use
            else:
                room, pattern, each = capacity, (), max(1, min(capacity // size, left))
                use = left // each
            made = pattern + (size,) * each
            rest = room - each * size
            free.setdefault(rest, Counter())[made] += use
            rooms[rest] = True
            left -= use * each
    return [(p, n) for found in free.values() for p, n in found.items()]


def completions(sizes: list[int], counts: dict[int, int], room: int, waste: int, limit: int, steps: int = 4000) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths at hand, least waste first, at most ``limit``.

    Larger lengths are tried first and the most that ``waste`` allows is left free.  A filling is dominated if one
    unused length could replace one or two of its members, being at least as long as they are together and still
    fitting: the members freed are then at least as easy to place elsewhere.
    """
    usable = [s for s in sizes if s <= room]
    tail = [0] * (len(usable) + 1)
    for k in range(len(usable) - 1, -1, -1):
        tail[k] = min(room + 1, tail[k + 1] + usable[k] * counts[usable[k]])
    order = np.array(usable[::-1], np.int64)
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [steps]

    def dominated(chosen: tuple[int, ...], slack: int) -> bool:
        used = Counter(chosen)
        parts = set(chosen) | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]} if len(chosen) <= 12 else set(chosen)
        for part in parts:
            lo = int(np.searchsorted(order, part + (part in used), "left"))
            hi = int(np.searchsorted(order, part + slack, "right"))
            if any(counts[int(s)] > used[int(s)] for s in order[lo : min(hi, lo + 8)]):
                return True
        return False

    def extend(k: int, left: int, chosen: tuple[int, ...], perfect: int) -> int:
        if budget[0] <= 0 or perfect >= limit:
            return perfect
        budget[0] -= 1
        while k < len(usable) and usable[k] > left:
            k = len(usable) - int(np.searchsorted(order, left, "right"))
        smallest = usable[-1] if usable else room + 1
        if left < smallest or k >= len(usable):
            if left <= waste and not (left and dominated(chosen, left)):
                found.append((left, chosen))
                return perfect + (left == 0)
            return perfect
        if left - tail[k] > waste:
            return perfect
        size = usable[k]
        for n in range(min(counts[size], left // size), -1, -1):
            perfect = extend(k + 1, left - n * size, chosen + (size,) * n, perfect)
            if budget[0] <= 0 or perfect >= limit:
                break
        return perfect

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * len(usable) + 2000))
    extend(0, room, (), 0)
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [c for _, c in dict.fromkeys(found)][:limit]


@dataclass
class Search:
    """What the branch-and-bound did: sequences used, the bound below, nodes visited, and the patterns."""

    patterns: list[tuple[tuple[int, ...], int]]
    sequences: int
    bound: int
    first: int
    nodes: int = 0
    proven: bool = False
    trail: list[int] = field(default_factory=list)


def bin_completion(counts: dict[int, int], capacity: int, node_limit: int = 6000, widths: tuple[int, ...] = (3, 12, 48)) -> Search:
    """Pack a histogram of lengths: searches that keep more and more fillings a node, until the bound is met or all have been made."""
    best = _search(counts, capacity, node_limit, widths[0])
    for width in widths[1:]:
        if best.proven:
            break
        found = _search(counts, capacity, node_limit, width)
        found.trail, found.nodes = best.trail + found.trail, best.nodes + found.nodes
        if found.sequences < best.sequences:
            best = found
        else:
            best.nodes, best.trail = found.nodes, found.trail
    return best


def _search(counts: dict[int, int], capacity: int, node_limit: int, width: int) -> Search:
    """One search over a histogram of lengths.

    At a node the largest length left is put into a sequence and the undominated fillings of the rest are its
    children, least waste first; a child is used for as many sequences as the counts allow at once.  A branch whose
    waste exceeds what the incumbent leaves is cut, and best fit completes every node into a possible new incumbent.
    The search stops when an incumbent meets the lower bound, or at ``node_limit`` nodes; either way
    the best packing found is returned, with the bound beside it.  Only a met bound proves it: a node keeps ``width``
    fillings and uses each as often as it can, so a search that runs out has not seen everything.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    if any(s > capacity or s < 1 for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    if not counts:
        return Search([], 0, 0, 0, proven=True)
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity)
    patterns = best_fit(counts, capacity)
    used = sum(n for _, n in patterns)
    state = Search(patterns, used, bound, used, proven=used == bound)

    def allowed() -> int:
        return (state.sequences - 1) * capacity - total

    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[tuple[dict[int, int], int, int, int, tuple[tuple[int, ...], int] | None]] = [(counts, 0, 0, 0, None)]
    every = max(1, len(counts) // 40)
    while stack and state.sequences > bound and state.nodes < node_limit:
        left, wasted, opened, depth, step = stack.pop()
        del path[max(0, depth - 1) :]
        if step:
            path.append(step)
        if wasted > allowed():
            continue
        state.nodes += 1
        if not left:
            if opened < state.sequences:
                state.patterns, state.sequences = list(path), opened
                state.trail.append(opened)
            continue
        if state.nodes % every == 0 or len(left) < 30:
            rest = best_fit(left, capacity)
            if (n := opened + sum(x for _, x in rest)) < state.sequences:
                state.patterns, state.sequences = path + rest, n
                state.trail.append(n)
                if n == bound:
                    break
        if opened + -(-(sum(s * n for s, n in left.items())) // capacity) >= state.sequences:
            continue
        sizes = sorted(left, reverse=True)
        large = sizes[0]
        rest = dict(left)
        rest[large] -= 1
        if not rest[large]:
            del rest[large]
        fill = completions(sorted(rest, reverse=True), rest, capacity - large, max(0, min(capacity, allowed() - wasted)), width)
        for chosen in reversed(fill):
            own = Counter((large, *chosen))
            times = min(left[s] // n for s, n in own.items())
            waste = capacity - large - sum(chosen)
            if waste:  # the same gap again and again costs its multiple
                times = max(1, min(times, (allowed() - wasted) // waste))
            after = dict(left)
            for s, n in own.items():
                after[s] -= n * times
                if not after[s]:
                    del after[s]
            stack.append((after, wasted + waste * times, opened + times, depth + 1, ((large, *chosen), times)))
    state.proven = state.sequences == bound
    return state


# ---- places -------------------------------------------------------------------------------------------------


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, sequences, first sequence, offset): rank r of a length, from ``first rank``, takes
    sequence ``first sequence + (r - first rank)`` at ``offset``."""
    out, taken, base = [], Counter(), 0
    for pattern, times in patterns:
        at = 0
        for size in pattern:
            out.append((size, taken[size], times, base, at))
            taken[size] += times
            at += size
        base += times
    return sorted(out)


def ranked(rows: DataFrame, key: str, order: list[str], per_bucket: int = 100_000) -> DataFrame:
    """Rank from 0 within ``key`` as ``rank``, without bringing all rows of one key into one task.

    Rows of a key are spread over hash buckets; bucket sizes, a small table, are summed up to give each bucket its
    first rank.  Equal rows are interchangeable, so a repeated task can only swap equals.
    """
    n = rows.count()
    salts = common.parts_for(n, per_bucket)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    if salts == 1:
        return rows.withColumn("rank", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")).drop("_salt")
    sizes = rows.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_salt").orderBy(*order)
    rows = rows.withColumn("rank", (F.row_number().over(own) - 1).cast("long"))
    return rows.join(sizes, [key, "_salt"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_salt", "_before")


def pack(pieces: DataFrame, capacity: int = 4096, node_limit: int = 6000, carry: list[str] | None = None) -> tuple[DataFrame, Search]:
    """Give each row of ``pieces`` (with ``doc_id, piece, start, length``) a ``sequence_id`` and an ``offset``."""
    carry = carry or []
    rows = pieces.select("doc_id", "piece", "start", "length", *carry)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = bin_completion(counts, capacity, node_limit)
    table = places(found.patterns)
    size = np.array([t[0] for t in table], np.int64)
    first = np.array([t[1] for t in table], np.int64)
    base = np.array([t[3] for t in table], np.int64)
    offset = np.array([t[4] for t in table], np.int64)
    width = np.int64(1) << 40
    key = size * width + first
    shared = rows.sparkSession.sparkContext.broadcast((key, first, base, offset))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, base, offset = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * width + rank, "right") - 1
            sequence = base[at] + rank - first[at]
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    order = ["doc_id", "piece", "start", "length", *carry]
    names = list(order)
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked(rows, "length", order).mapInArrow(seat, schema), found


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, node_limit: int = 6000) -> tuple[DataFrame, DataFrame, Search]:
    """Tokenise, store the pieces once in the shared folder, and place them.

    Returns the stored pieces with their ids, the index ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and the account of the search.  Only lengths and checksums are shuffled, never ids.
    """
    stored = common.spool(token_pieces(docs, tokenizer, capacity, end_id), "token-pieces", "zstd")
    index, found = pack(stored.withColumn("ids_crc32", F.crc32("ids")), capacity, node_limit, ["ids_crc32"])
    return stored, index, found
