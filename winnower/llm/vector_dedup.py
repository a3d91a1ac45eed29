"""Near-duplicate vectors by a robust-pruned flat graph.

1.  Equal vectors of a label become one node that counts its copies.
2.  Centroids are fitted on a bounded sample; every node joins the shards of its nearest ``overlap`` centroids within
    its label, so shards overlap.
3.  Each shard builds a graph: nearest candidates from small overlapping cells, robust-pruned to ``degree`` edges.
4.  The adjacency lists of a node's shards are united.
5.  In each shard every node searches the united graph: greedily from the shard's medoids, then expanding whatever lies
    within the range (and a margin around it) until nothing new is in range.  Every hit is verified in double precision.
6.  Recall is audited against brute force for a twentieth of the nodes over all nodes; below ``least_recall`` the index is
    built again with more overlap.  With no link to judge by, or no overlap left to add, all pairs within a label are compared.

Shards return each node's number of links and a spanning forest, never all pairs.  A pair of nodes that share several
shards is counted in the first.  A shard over ``max_shard`` nodes is dealt as pairs of chunks, which together hold every pair.

Edge cases: vectors that are null, empty or zero, that hold null or non-finite components, and those with a null label
link with nothing; vectors of different lengths never link; repeated ids with equal vectors are one node with copies, with
different vectors different nodes; a row without an id links like any other, names no component that has an id, and is
kept where none has; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import common, components

THRESHOLD = 0.93


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safely for very large and very small components."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def candidates(v: np.ndarray, pool: int, overlap: int = 3, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(n, pool) nearest others of each node, -1 where empty, and their cosines, looked for among the nodes that share one of its
    ``overlap`` nearest cells; there are about as many cells as nodes in a cell, so far fewer than all pairs are compared."""
    n = len(v)
    cells = [np.arange(n)]
    if n > 512:
        cents = centroids(v, int(np.sqrt(n)), rounds=2, seed=seed)
        near = np.argpartition(-(v @ cents.T), overlap - 1, axis=1)[:, :overlap] if len(cents) > overlap else np.tile(np.arange(len(cents)), (n, 1))
        order = np.argsort(near.ravel(), kind="stable")
        cells = np.split(order // near.shape[1], np.cumsum(np.bincount(near.ravel(), minlength=len(cents)))[:-1])
    found = np.full((n, pool), -1, np.int64)
    cosine = np.full((n, pool), -np.inf)
    for cell in cells:
        for lo in range(0, len(cell), 256):
            own = cell[lo : lo + 256]
            s = v[own] @ v[cell].T
            s[np.arange(len(own)), lo + np.arange(len(own))] = -np.inf
            take = min(pool, len(cell))
            top = np.argpartition(-s, take - 1, axis=1)[:, :take]
            ids, s = np.concatenate([found[own], cell[top]], 1), np.concatenate([cosine[own], np.take_along_axis(s, top, 1)], 1)
            order = np.lexsort((-s, ids))  # a neighbour met in two cells counts once
            ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
            s[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, :pool]
            found[own], cosine[own] = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
    found[cosine == -np.inf] = -1
    return found, cosine


def robust_prune(v: np.ndarray, degree: int = 24, pool: int = 48, alpha: float = 1.2) -> np.ndarray:
    """Adjacency (n, degree), -1 where empty: of each node's ``pool`` nearest, those that no chosen nearer one covers.

    Candidate c is covered by a chosen p if alpha * d(p, c) <= d(node, c), with squared distances 2 - 2 cos.
    """
    n = len(v)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int32)
    if pool <= 0:
        return out
    found, cosine = candidates(v, pool)
    for lo in range(0, n, 256):
        near, s = found[lo : lo + 256], cosine[lo : lo + 256]
        among = np.einsum("bpk,bqk->bpq", v[near], v[near])
        alive = near >= 0
        rows = np.arange(len(near))
        for d in range(degree):
            live = alive.any(1)
            if not live.any():
                break
            pick = alive.argmax(1)
            out[lo + rows[live], d] = near[rows, pick][live]
            covered = alpha * (2 - 2 * among[rows, pick]) <= 2 - 2 * s
            alive &= ~covered
            alive[rows, pick] = False
    return out


def medoids(v: np.ndarray, count: int = 16) -> np.ndarray:
    """The node nearest the mean, then the ones farthest from those taken."""
    first = int((v @ v.mean(0)).argmax())
    chosen, best = [first], v @ v[first]
    while len(chosen) < min(count, len(v)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, v @ v[chosen[-1]])
    return np.array(chosen)


def _neighbours(adjacency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of both directions as (begin of each node's, nodes)."""
    n = len(adjacency)
    src, at = np.nonzero(adjacency >= 0)
    dst = adjacency[src, at].astype(np.int64)
    edges = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return np.searchsorted(edges, np.arange(n + 1) * n), edges % n


def range_search(v: np.ndarray, adjacency: np.ndarray, threshold: float, beam: int = 16, margin: float = 0.12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (query, found) index pairs with cosine at least ``threshold``, query != found, for all nodes as queries.

    A beam is walked greedily from the medoids until all it holds has been opened; then the neighbours of all nodes found within
    ``threshold - margin`` are looked at, again and again, until no new node falls within it.  Only nodes reached over edges
    are compared.
    """
    n = len(v)
    entry = medoids(v)
    begin, to = _neighbours(adjacency)

    def spread(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and neighbour of each (query, node)."""
        counts = begin[c + 1] - begin[c]
        at = np.repeat(begin[c] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return np.repeat(r, counts), to[at]

    for lo in range(0, n, 256):
        q = np.arange(lo, min(lo + 256, n))
        m = len(q)
        seen = np.zeros((m, n), bool)
        seen[np.arange(m), q] = True
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The pairs not seen before, with their cosines."""
            fresh = ~seen[r, c]
            code = np.unique(r[fresh] * n + c[fresh])
            r, c = code // n, code % n
            seen[r, c] = True
            s = np.empty(len(r))
            for a in range(0, len(r), 1 << 16):
                s[a : a + (1 << 16)] = np.einsum("ij,ij->i", v[q[r[a : a + (1 << 16)]]], v[c[a : a + (1 << 16)]])
            wide = s >= threshold - margin
            kept.append((r[wide], c[wide], s[wide]))
            return r, c, s

        held, cosine, opened = np.full((m, beam), -1, np.int64), np.full((m, beam), -2.0), np.ones((m, beam), bool)

        def push(r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
            """Merge what was looked at into the beams."""
            nonlocal held, cosine, opened
            order = np.lexsort((-s, r))
            r, c, s = r[order], c[order], s[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, s, place = (x[place < beam] for x in (r, c, s, place))
            ids, sims, done = np.full((m, beam), -1, np.int64), np.full((m, beam), -2.0), np.ones((m, beam), bool)
            ids[r, place], sims[r, place], done[r, place] = c, s, False
            ids, sims, done = np.concatenate([held, ids], 1), np.concatenate([cosine, sims], 1), np.concatenate([opened, done], 1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            held, cosine, opened = (np.take_along_axis(x, top, 1) for x in (ids, sims, done))

        push(*look(*spread(np.arange(m), q)))  # a query is a node itself: its own edges too
        push(*look(np.repeat(np.arange(m), len(entry)), np.tile(entry, m)))
        while not opened.all():
            r = np.flatnonzero(~opened.all(1))
            first = opened[r].argmin(1)
            opened[r, first] = True
            push(*look(*spread(r, held[r, first])))
        front = [np.concatenate(x) for x in zip(*kept)][:2]
        while len(front[0]):
            front = look(*spread(*front))
            wide = front[2] >= threshold - margin
            front = [front[0][wide], front[1][wide]]
        r, c, s = (np.concatenate(x) for x in zip(*kept))
        yield q[r[s >= threshold]], c[s >= threshold]


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(all rows with their node or null, nodes with ``least`` id, ``copies`` and the unit vector): equal vectors of a label are one node.

    Nodes are named by a hash; ``check`` is another, by which two vectors of one name are noticed.
    """
    e = F.col(embedding).cast("array<double>")
    fine = F.col(label).isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fine &= ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(fine, e).alias("v"))
    # the same direction of -0.0 and 0.0 is the same vector
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    names = {k: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(s), "label", "v")) for k, s in (("node", seed), ("check", seed + 1))}
    rows = rows.withColumns(names)
    nodes = rows.where("node is not null").groupBy("node", "check").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    return rows.select("vec_id", "node"), nodes


def _assign(nodes: DataFrame, cents: np.ndarray, overlap: int) -> DataFrame:
    """``node, copies, label, v, shards``: nearest centroids of each node."""
    shared = nodes.sparkSession.sparkContext.broadcast(cents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = shared.value
        k = min(overlap, len(cents))
        for batch in batches:
            sizes = np.diff(np.r_[0, np.cumsum([len(x) for x in batch.column("v").to_pylist()])])
            near = np.zeros((batch.num_rows, k), np.int32)
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                if width == cents.shape[1]:  # vectors of other lengths all go to shard 0
                    v = unit(_matrix(batch.column("v").take(pa.array(at)), len(at)))
                    near[at] = np.argsort(-(v @ cents.T), axis=1)[:, :k]
            shards = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * k, pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "label", "v")), shards], names=["node", "copies", "label", "v", "shards"])

    return nodes.select("node", "copies", "label", "v").mapInArrow(run, "node long, copies long, label string, v array<double>, shards array<int>")


def _dealt(assigned: DataFrame, max_shard: int) -> DataFrame:
    """A row for each shard a node belongs to; shards over ``max_shard`` as pairs of chunks (x, y)."""
    rows = assigned.withColumn("shard", F.explode(F.array_distinct("shards"))).withColumn("width", F.size("v"))
    sizes = rows.groupBy("label", "width", "shard").agg(F.ceil(F.count("*") / (max_shard // 2)).cast("int").alias("g"))
    sizes = sizes.withColumn("g", F.when(F.col("g") <= 2, 1).otherwise(F.col("g")))
    rows = rows.join(sizes, ["label", "width", "shard"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    return rows.where("x <> y or own = other").select("label", "width", "shard", "x", "y", "own", "node", "copies", "v", "shards")


_GROUP = ["label", "width", "shard", "x", "y"]


def _edges(table: pa.Table) -> pa.Table:
    """One shard's pruned graph as adjacency lists."""
    node = table.column("node").to_numpy()
    adjacency = robust_prune(unit(_matrix(table.column("v"), len(node))))
    r, c = np.nonzero(adjacency >= 0)
    counts = np.bincount(r, minlength=len(node))
    flat = node[adjacency[r, c]]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int64()))
    return pa.table({"node": pa.array(node), "near": lists})


def _search(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One shard's links: (a, null, number of links) and forest edges (a, b, 0)."""
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        own, x, y, shard = (table.column(c).to_numpy() for c in ("own", "x", "y", "shard"))
        n = len(node)
        v = unit(_matrix(table.column("v"), n))
        shards = np.array(table.column("shards").to_pylist(), np.int32).reshape(n, -1)
        order = np.argsort(node)
        lists = table.column("near").to_pylist()
        flat = np.array([d for near in lists for d in near or ()], np.int64)
        row = np.repeat(np.arange(n), [len(near or ()) for near in lists])
        at = np.minimum(np.searchsorted(node[order], flat), n - 1)
        here = node[order][at] == flat  # united lists also name nodes of other shards
        row, to = row[here], order[at[here]]
        place = np.arange(len(row)) - np.r_[0, np.cumsum(np.bincount(row, minlength=n))][row]
        adjacency = np.full((n, int(place.max()) + 1 if len(place) else 1), -1, np.int32)
        adjacency[row, place] = to
        total = np.zeros(n, np.int64)
        heads: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        for q, c in range_search(v, adjacency, threshold):
            if x[0] != y[0]:
                apart = own[q] != own[c]
                q, c = q[apart], c[apart]
            common_ = np.where((shards[q][:, :, None] == shards[c][:, None, :]).any(2), shards[q], np.iinfo(np.int32).max).min(1)
            mine = common_ == shard[0]
            q, c = q[mine], c[mine]
            # found from either side it is a link of both
            total += np.bincount(q, weights=copies[c], minlength=n).astype(np.int64)
            a, b = components.local_stars(np.r_[heads[0][0], node[q]], np.r_[heads[0][1], node[c]])
            heads = [np.stack([a, b])]
        linked = np.flatnonzero(total)
        a = np.r_[node[linked], heads[0][0]]
        b = pa.array(np.r_[np.zeros(len(linked), np.int64), heads[0][1]], mask=np.r_[np.ones(len(linked), bool), np.zeros(heads[0].shape[1], bool)])
        return pa.table({"a": pa.array(a), "b": b, "n": pa.array(np.r_[total[linked], np.zeros(heads[0].shape[1], np.int64)])})

    return run


def links(nodes: DataFrame, cents: np.ndarray, overlap: int, threshold: float, max_shard: int) -> DataFrame:
    """``a, b, n``: links per node and shard (b null), and forest edges (n 0)."""
    assigned = common.spool(_assign(nodes, cents, overlap), "vectors-assigned")
    dealt = _dealt(assigned, max_shard)
    united = dealt.groupBy(*_GROUP).applyInArrow(_edges, "node long, near array<long>")
    united = united.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = common.spool(united, "vectors-adjacency")
    found = dealt.join(united, "node", "left").groupBy(*_GROUP).applyInArrow(_search(threshold), "a long, b long, n long")
    return common.spool(found, "vectors-links")


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """What ``_search`` returns, from all pairs of one group."""
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        own, x, y = (table.column(c).to_numpy() for c in ("own", "x", "y"))
        n = len(node)
        v = unit(_matrix(table.column("v"), n))
        total, heads = np.zeros(n, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for at in range(0, n, 512):
            q, c = np.nonzero(v[at : at + 512] @ v.T >= threshold)
            q += at
            keep = (q != c) if x[0] == y[0] else own[q] != own[c]
            q, c = q[keep], c[keep]
            total += np.bincount(q, weights=copies[c], minlength=n).astype(np.int64)
            heads = components.local_stars(np.r_[heads[0], node[q]], np.r_[heads[1], node[c]])
        linked = np.flatnonzero(total)
        b = pa.array(np.r_[np.zeros(len(linked), np.int64), heads[1]], mask=np.r_[np.ones(len(linked), bool), np.zeros(len(heads[1]), bool)])
        return pa.table({"a": pa.array(np.r_[node[linked], heads[0]]), "b": b, "n": pa.array(np.r_[total[linked], np.zeros(len(heads[0]), np.int64)])})

    return run


def exact_links(nodes: DataFrame, threshold: float, max_shard: int) -> DataFrame:
    """What ``links`` returns, from all pairs within a label, in pairs of bounded chunks."""
    dealt = _dealt(nodes.select("node", "copies", "label", "v", F.array(F.lit(0)).alias("shards")), max_shard)
    return common.spool(dealt.groupBy(*_GROUP).applyInArrow(_compare(threshold), "a long, b long, n long"), "vectors-links")


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, every: int = 20, block: int = 2048) -> tuple[int, int]:
    """(links found, links there) of the nodes whose id ``every`` divides, by brute force over all nodes, a block at a time."""
    chosen = nodes.where(F.pmod("least", F.lit(every)) == 0)
    blocks = -(-chosen.count() // block)
    found = there = 0
    for k in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)) == k).select("node", "label", "v").collect()
        hit, all_ = _audit_block(nodes, counted, threshold, rows) if rows else (0, 0)
        found, there = found + hit, there + all_
    return found, there


def _audit_block(nodes: DataFrame, counted: DataFrame, threshold: float, chosen: list) -> tuple[int, int]:
    q: dict[tuple[str, int], list] = {}
    for r in chosen:
        q.setdefault((r["label"], len(r["v"])), []).append((r["node"], r["v"]))
    q = {k: (np.array([i for i, _ in rows]), unit(np.array([v for _, v in rows]))) for k, rows in q.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column("label").to_pylist(), object)
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            size = np.array([len(x) for x in batch.column("v").to_pylist()])
            out = []
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                v = unit(_matrix(batch.column("v").take(pa.array(at)), len(at)))
                for (lab, w), (ids, u) in q.items():
                    if w == width:
                        own = label[at] == lab
                        hit = (v[own] @ u.T >= threshold) & (node[at][own][:, None] != ids)
                        out += zip(ids.tolist(), (copies[at][own] @ hit).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["node", "there"])

    there = nodes.select("node", "copies", "label", "v").mapInArrow(run, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    row = there.join(counted, "node", "left").agg(F.sum(F.least("there", F.coalesce("n", F.lit(0)))).alias("found"), F.sum("there").alias("there")).first()
    return int(row["found"] or 0), int(row["there"] or 0)


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = 3, shard_rows: int = 1500, max_shard: int = 4096, sample_rows: int = 40_000,
    max_centroids: int = 4096, least_recall: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> tuple[DataFrame, dict]:
    """``vec_id, n_links, component_id, kept`` for each row, and the audit ``{"found", "there", "recall", "overlap"}``."""
    seed = 0
    while True:
        rows, nodes = nodes_of(vectors, vec_id, embedding, label, seed)
        rows, nodes = common.spool(rows, "vector-rows"), common.spool(nodes, "vector-nodes")
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            break
        common.unspool(rows, nodes)  # two vectors of one name
        seed += 2
    n = nodes.count()
    audited = {"found": 0, "there": 0, "recall": 1.0, "overlap": overlap}
    counted = components_ = None
    if n:
        every = max(1, n // sample_rows)
        width = nodes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").first()["w"]
        sample = nodes.where((F.pmod(F.xxhash64("node"), F.lit(every)) == 0) & (F.size("v") == width)).select("v").limit(2 * sample_rows).collect()
        sample = unit(np.array([r["v"] for r in sample])) if sample else np.ones((1, width)) / np.sqrt(width)
        cents = centroids(sample, int(min(max_centroids, max(1, round(n / shard_rows)))))
        while True:
            found = links(nodes, cents, overlap, threshold, max_shard)
            counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
            hit, there = audit(nodes, counted, threshold)
            audited = {"found": hit, "there": there, "recall": hit / there if there else 1.0, "overlap": overlap}
            if there and audited["recall"] >= least_recall:
                break
            if not there or overlap >= len(cents):  # nothing to judge by, or nothing left to widen: compare all pairs
                found = exact_links(nodes, threshold, max_shard)
                counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
                hit, there = audit(nodes, counted, threshold)
                audited = {"found": hit, "there": there, "recall": hit / there if there else 1.0, "overlap": overlap}
                break
            overlap += 2
        components_ = components.connected(found.where("b is not null").select("a", "b"))
        nodes = nodes.select("node", "least", "copies").join(counted, "node", "left").join(components_, "node", "left")
        nodes = nodes.withColumn("component", F.coalesce("component", "node"))
        ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
        nodes = nodes.join(ids, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    else:
        nodes = nodes.select("node", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    out = rows.join(nodes, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), audited


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
       FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
c AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT m.x AS vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, m.x = m.component_id AS kept FROM m LEFT JOIN c ON c.x = m.x
"""
