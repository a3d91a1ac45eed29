"""N-gram Jaccard join with adaptive multi-match prefixes.

Tokens are distinct 5-word shingles, hashed to 64 bits.  Two sets with Jaccard of at least t share at least l tokens of
their prefixes when a prefix is the first ``n - ceil(t n) + l`` tokens of a common order.  Each document picks the l whose
estimated cost (postings to write, candidates to verify) is least; a pair must share the smaller of its two l's.

Steps:

1.  A fixed-size count sketch over every shingle of every document gives the common order, rare first.  It estimates,
    it never filters: any common order is exact.
2.  Documents with equal sets become one node.  Prefixes are posted by token.
3.  In each token's list the member with the fewest rarer tokens leads.  Each node is verified against its most
    frequent leader only: a copy group becomes a star, not all its pairs.
4.  Between the components so found, pairs that share enough prefix tokens at the positions their sizes allow
    are counted and verified.  Pairs inside a component are never made; a token list too long for one task is dealt as
    pairs of bounded chunks.

Edge cases: null, empty or blank text has an empty set, which links with nothing; fewer words than a shingle make one
token of the whole; repeated rows and copies form one component; extra columns are ignored; a null id links like any other
and is named only where no other id of its component is left.  Node names are 64-bit fingerprints of the whole set; a
second fingerprint tells whether two sets share a name, and then all are named anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.llm import common, components

SHINGLE = 5
#: The least Jaccard of a link, as a fraction.
NUM, DEN = 3, 4
SKETCH_BITS = 22
_PIECE = 1 << 14
#: Choices of l.
_ELLS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48])
#: Cost of verifying one token of a candidate, in units of writing one posting.
_VERIFY = 0.25
#: Members of a token's list that one task compares with one another.
CHUNK = 4096
#: Turns in which prefixes are posted, each with its own tokens, so that one turn's shuffle is on disk at a time.
TURNS = 4


def row_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) over an Arrow text column."""
    for at, to, data, offsets in common.text_chunks(column):
        starts, ends, first = common.words_of(data, offsets)
        h = common.word_hashes(data, starts, ends)
        grams = common.windows_of(h, SHINGLE)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                sets.append(np.unique(grams[a : b - SHINGLE + 1]))
            else:
                sets.append(common.windows_of(h[a:b], b - a) if b > a else grams[:0])
        yield at, sets


# ---- 1. the common order


def _pack(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65536 else np.uint32 if counts.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), np.dtype(f"<u{blob[0]}")).astype(np.uint64)


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum counters by piece, holding one array per piece."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = _unpack(blob)
            total[piece] = total[piece] + counts if piece in total else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_pack(c) for c in total.values()], pa.binary())], names=["piece", "counts"])


def shingle_sketch(texts: DataFrame, bits: int = SKETCH_BITS) -> tuple[np.ndarray, float]:
    """Number of documents per hash slot, on a logarithmic scale above the mean: one byte a slot, 2**bits slots; and the
    noise of the slots, the root of the mean.

    Counters have one size whatever the input's.  They are added up on the executors in two levels; the driver gets
    2**bits bytes or little more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, sets in row_sets(batch.column(0)):
                if sets:
                    slots, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                    counts[slots] += n.astype(np.uint32)
        rows = [(k, _pack(c)) for k, c in enumerate(counts.reshape(-1, min(_PIECE, len(counts)))) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["piece", "counts"])

    kind = "piece int, counts binary"
    parts = texts.mapInArrow(count, kind)
    width = min(_PIECE, 1 << bits)
    level = parts.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(16))).repartition(64, "piece", "_s").drop("_s")
    summed = level.mapInArrow(_sum_pieces, kind).repartition(16, "piece").mapInArrow(_sum_pieces, kind).collect()
    counts = np.zeros(1 << bits, np.uint64)
    for r in summed:
        counts[r["piece"] * width : (r["piece"] + 1) * width] += _unpack(bytes(r["counts"]))
    over = np.maximum(counts.astype(np.float64) - np.floor(counts.mean()), 0)
    return np.minimum(255, np.floor(8 * np.log2(1 + over))).astype(np.uint8), float(np.sqrt(counts.mean()))


# ---- 2. prefixes


def choose_ell(frequency: np.ndarray, n: int) -> int:
    """The l of least estimated cost, given the estimated document frequencies of a set in the common order.

    A candidate found with l shares l postings, so l divides the number of candidates that the postings of the
    longer prefix can hold.
    """
    base = n - (NUM * n + DEN - 1) // DEN
    ells = _ELLS[_ELLS <= n // 16 + 1]
    held = np.cumsum(frequency[: base + int(ells[-1])])[base + ells - 1]
    cost = (base + ells) + _VERIFY * n * held / ells
    return int(ells[int(np.argmin(cost))])


def fingerprint(s: np.ndarray, seed: int) -> int:
    """Of a set of token hashes; 0 is the empty set's."""
    if not len(s):
        return 0
    turn = np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) if seed else np.uint64(0)
    return int(common.mix(np.add.reduce(common.mix(s ^ turn), keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def prefixes(docs: DataFrame, sketch, bits: int, seed: int = 0) -> DataFrame:
    """``doc_id, n, node, check, ell, prefix``: set size, fingerprints of the set, l and the prefix's tokens in order.

    Only the first row with a given set in a task carries its prefix, so a copy group posts no more than once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (order, noise), seen = sketch.value, set()
        guess = 2 ** (np.arange(256) / 8) - 1 + noise  # a slot at the mean may still hide that many
        for batch in batches:
            sizes, nodes, checks, ells, tokens, ends = [], [], [], [], [], [0]
            for _, sets in row_sets(batch.column(1)):
                for s in sets:
                    n = len(s)
                    node = fingerprint(s, seed)
                    sizes.append(n)
                    nodes.append(node)
                    checks.append(fingerprint(s, seed + 1))
                    if n and node not in seen:
                        seen.add(node)
                        rank = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
                        at = np.argsort(rank, kind="stable")
                        ell = choose_ell(guess[rank[at[: n // 2 + 20]]], n)
                        keep = s[at[: n - (NUM * n + DEN - 1) // DEN + ell]]
                        tokens.append(keep.view(np.int64))
                        ells.append(ell)
                        ends.append(ends[-1] + len(keep))
                    else:
                        ells.append(0)
                        ends.append(ends[-1])
                if len(seen) > 1_000_000:  # forgetting only posts a copy once more
                    seen.clear()
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(ells, pa.int32()), prefix],
                names=["doc_id", "n", "node", "check", "ell", "prefix"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, node long, check long, ell int, prefix array<long>")


def _meta(n: Column, pos: Column, ell: Column) -> Column:
    """Set size, position and l in one long."""
    return F.shiftleft(n.cast("long"), 34).bitwiseOR(F.shiftleft(pos.cast("long"), 8)).bitwiseOR(ell.cast("long"))


def _unmeta(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return meta >> 34, (meta >> 8) & ((1 << 26) - 1), meta & 255


def shared_postings(table: DataFrame) -> DataFrame:
    """``token, node, meta, leader, leader_meta`` of the tokens in at least two nodes' prefixes.

    A pair shares the smaller of its two l's.  So a node links with nothing if fewer of its prefix tokens are in anyone
    else's than the least l in any of its lists; such nodes go, and lists that only they kept above one node with them.
    A token that nobody else posts says nothing more: it may still be in another's set, beyond the end of that prefix.
    """
    posted = table.where("ell > 0").select("node", "n", "ell", F.posexplode("prefix").alias("pos", "token"))
    posted = posted.select("token", _meta(F.col("n"), F.col("pos"), F.col("ell")).alias("meta"), "node")
    turns = []
    for k in range(TURNS):
        # led by the least l
        turns.append(common.spool(_runs(posted.where(F.pmod("token", F.lit(TURNS)) == k).repartition("token"), 255), "postings"))
        common.free_shuffles(table.sparkSession)
    found = reduce(DataFrame.unionAll, turns)
    # a token counts twice where a copy's postings span two Arrow batches, which only lets a node on
    own = found.groupBy("node").agg(F.count("*").alias("c"), F.min(_ell("leader_meta")).alias("least"))
    own = own.where("c >= least").select("node")
    rest = found.select("token", "node", "meta").join(own, "node", "left_semi").select("token", "meta", "node")
    shared = common.spool(_runs(rest.repartition(common.parts_for(found.count(), 100_000), "token")), "postings")
    common.unspool(*turns)
    return shared


def posted_heads(table: DataFrame, shared: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``node, n, prefix``, stored, of the nodes that share postings, which alone can be in pairs.

    31 bits of a token do to count what two prefixes share: a chance hit can only let a pair on to the exact comparison.
    """
    nodes = common.spool(shared.select("node").distinct(), "posted")
    few = nodes.count() <= broadcast_rows
    short = F.transform("prefix", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix")
    heads = table.where("ell > 0").join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    heads = common.spool(heads.select("node", "n", short), "heads")
    common.unspool(nodes)
    return heads


def _runs(posted: DataFrame, by: int = (1 << 34) - 1) -> DataFrame:
    """The postings of tokens that two nodes or more share, with the list's leader, as the sorted rows stream by.

    The first of a token's run leads, by position or by other bits of ``meta``; a run is passed on whatever its length and never held.
    """
    posted = posted.withColumn("_p", F.col("meta").bitwiseAND(F.lit(by))).sortWithinPartitions("token", "_p", "node").drop("_p")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # (columns of the leader, whether it has been passed on) of the run that the last batch ended in
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(3)]
            if not len(cols[0]):
                continue
            if lead is not None:
                cols = [np.r_[a, c] for a, c in zip(lead[0], cols)]
            token, meta, node = cols[:3]
            begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[begin, len(token)])
            head = np.repeat(begin, sizes)
            other = node != node[head]
            other &= np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # a copy posted by another task
            many = np.add.reduceat(other, begin) > 0
            out = np.repeat(many, sizes) & (other | (np.arange(len(token)) == head))
            passed = bool(many[-1])
            if lead is not None and lead[1]:
                out[0] = False
                passed |= len(begin) == 1
            k = int(begin[-1])
            lead = ([c[k] for c in cols], passed)
            at = np.flatnonzero(out)
            keep = [token[at], node[at], meta[at], node[head[at]], meta[head[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in keep], names=["token", "node", "meta", "leader", "leader_meta"])

    return posted.mapInArrow(runs, "token long, node long, meta long, leader long, leader_meta long")


# ---- 3. stars


def _size(meta: str) -> Column:
    return F.shiftright(meta, 34)


def _ell(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit(255))


def star_pairs(shared: DataFrame) -> DataFrame:
    """Each node with the leader that it meets in most token lists: ``a, b``."""
    met = shared.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"), F.max("meta").alias("meta"), F.max("leader_meta").alias("leader_meta"))
    small, large = F.least(_size("meta"), _size("leader_meta")), F.greatest(_size("meta"), _size("leader_meta"))
    met = met.where((F.col("c") >= F.least(_ell("meta"), _ell("leader_meta"))) & (DEN * small >= NUM * large))
    best = met.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader"))
    return best.select(F.col("leader").alias("a"), F.col("node").alias("b"))


# ---- 4. the rest


def cross_pairs(heads: DataFrame, shared: DataFrame, comps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: pairs of nodes in different components that share enough prefix tokens.

    l tokens shared within the first ``n - need + l`` places mean one within the first ``n - need + 1``: pairs are made
    from those places only, and the l tokens are then counted on the two prefixes.  A token at places p and q leaves room
    for ``min(p, q)`` common tokens before it and for the shorter of the two remainders after it.
    """
    rows = shared.select("token", "node", "meta").join(comps, "node", "left")
    rows = rows.select("token", "node", "meta", F.coalesce("component", "node").alias("comp"))
    lists = rows.groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = rows.join(lists.select("token", F.ceil(F.col("c") / chunk).cast("int").alias("g")), "token")
    own = F.when(F.col("g") > 1, F.pmod(F.xxhash64("node"), F.col("g"))).otherwise(0).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "meta", "comp")
    rows = rows.repartition(common.parts_for(shared.count(), 20_000), "token", "x", "y").sortWithinPartitions("token", "x", "y", "comp", "node")

    def pairs(token, x, y, own, node, meta, comp):
        n, pos, ell = _unmeta(meta)
        after = n - pos
        block = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        for lo, hi in zip(block.tolist(), np.r_[block[1:], len(token)].tolist()):
            if comp[lo] == comp[hi - 1]:
                continue
            _, first, size = np.unique(comp[lo:hi], return_index=True, return_counts=True)
            big = int(np.argmax(size))
            most = slice(lo + int(first[big]), lo + int(first[big] + size[big]))
            for i in [*range(lo, most.start), *range(most.stop, hi)]:  # the largest component's rows are only met
                for j in (np.arange(i + 1, hi), np.arange(most.start, most.stop)) if i >= most.stop else (np.arange(i + 1, hi),):
                    j = j[comp[j] != comp[i]]
                    if x[i] != y[i]:
                        j = j[own[j] != own[i]]
                    need = -(-NUM * (n[i] + n[j]) // (NUM + DEN))
                    low = np.minimum(ell[i], ell[j])
                    ok = (need <= np.minimum(pos[i], pos[j]) + np.minimum(after[i], after[j])) & (pos[i] <= n[i] - need) & (pos[j] <= n[j] - need)
                    j = j[ok]
                    if len(j):
                        yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), low[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names = ["a", "b", "low"]

        def emit(cols):
            out, size = [], 0
            for p in pairs(*cols):
                out.append(p)
                size += len(p[0])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(7)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [c[cut:] for c in cols]
            yield from emit([c[:cut] for c in cols]) if cut else ()
        if held is not None:
            yield from emit(held)

    found = common.spool(rows.mapInArrow(run, "a long, b long, low long").distinct(), "cross")
    common.free_shuffles(heads.sparkSession)
    nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    heads = heads.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    both = found.join(heads.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb")), "b")
    both = both.join(heads.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa")), "a")
    spare = F.col("low") - F.ceil(NUM * (F.col("na") + F.col("nb")) / (NUM + DEN))
    ends = [F.slice(f"p{k}", F.lit(1), (F.col(f"n{k}") + spare).cast("int")) for k in "ab"]
    checked = common.spool(both.where(F.size(F.array_intersect(*ends)) >= F.col("low")).select("a", "b"), "cross-checked")
    common.unspool(found)
    common.free_shuffles(heads.sparkSession)
    return checked


def node_sets(docs: DataFrame, pairs: DataFrame, rep: DataFrame, seed: int, broadcast_rows: int = 500_000) -> DataFrame:
    """``node, shingles`` of the nodes in the given pairs, stored, from the text of one document each (repeated ids give others too)."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = rep.join(nodes, "node", "left_semi").select(F.col("rep").alias("_rep"))
    ids = common.spool(ids, "wanted")
    few = ids.count() <= broadcast_rows
    wanted = docs.join(F.broadcast(ids) if few else ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in row_sets(batch.column(1)):
                sets = [s for s in sets if len(s)]
                nodes = [fingerprint(s, seed) for s in sets]
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["node", "shingles"]
                )

    found = common.spool(wanted.mapInArrow(run, "node long, shingles array<long>"), "sets")
    common.unspool(ids)
    common.free_shuffles(docs.sparkSession)
    return found


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets reach the threshold exactly."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(b, "b").join(a, "a")
    common_ = F.size(F.array_intersect("sa", "sb"))
    return both.where((NUM + DEN) * common_ >= NUM * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: its set's size and the least doc_id reachable by links."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(shingle_sketch(docs.select("text"), sketch_bits))
    seed = 0
    while True:
        table = common.spool(prefixes(docs, sketch, sketch_bits, seed), "prefixes")
        classes = table.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), (F.min("check") != F.max("check")).alias("clash"))
        classes = common.spool(classes, "classes")
        if classes.where("clash").isEmpty():
            break
        common.unspool(table, classes)  # two sets of one name
        seed += 2
    common.free_shuffles(spark)
    shared = shared_postings(table)
    common.free_shuffles(spark)
    # of the prefixes, by far the largest table, what is needed further on is stored apart
    heads = posted_heads(table, shared)
    members = common.spool(table.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), "members")
    common.unspool(table)
    common.free_shuffles(spark)

    pairs = common.spool(star_pairs(shared), "stars")
    sets = node_sets(docs, pairs, classes, seed)
    links = common.spool(verified(pairs, sets), "links")
    comps = components.connected(links)
    common.unspool(sets, pairs)
    common.free_shuffles(spark)

    pairs = cross_pairs(heads, shared, comps)
    common.unspool(shared, heads)
    sets = node_sets(docs, pairs, classes, seed)
    more = common.spool(verified(pairs, sets), "links")
    common.unspool(sets, pairs, comps)
    comps = components.connected(links.unionAll(more))
    common.unspool(links, more)

    common.free_shuffles(spark)
    named = classes.join(comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = members.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT da.doc_id AS x, db.doc_id AS y FROM p JOIN n na ON na.rid = x JOIN n nb ON nb.rid = y JOIN d da ON da.rid = x JOIN d db ON db.rid = y
      WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id::BIGINT AS component_id FROM d LEFT JOIN n USING (rid) JOIN m ON m.x = d.doc_id
"""
