"""Nearest neighbours by largest inner product: an NN-descent graph made by joins, searched greedily.

Equal vectors are one node. A first graph joins nodes that random hyperplanes put side by side; then, round after round,
the neighbours and reverse neighbours of each node meet in one row group and propose each other, since a neighbour of a
neighbour is likely a neighbour. The graph compares directions (cosine), so no norm changes how others are linked.
Queries walk the graph in rounds of joins: each keeps its nearest nodes by inner product so far and opens the nearest
that it has not opened; nodes of rare large norms are entries of every walk. Walks use half-precision directions and
single-precision norms, results exact inner products in double. What walks find is measured: for some queries all rows
are scanned, and where walks miss too many of their nearest, all walk again with a wider beam, at the end by a scan of
all rows for all queries, in blocks.
"""

from __future__ import annotations

import logging
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, in_arrow

#: Neighbours of a node, rounds at most, share of new neighbours at which rounds end, hash tables and their block.
NEIGHBOURS, ROUNDS, SETTLED, TABLES, BLOCK = 20, 6, 0.08, 4, 384
#: Proposals that a member takes from one meeting; (nodes that a query holds, opens per hop, hops at most), wider each time.
PROPOSALS, WALKS = 8, ((400, 120, 10), (1200, 300, 12))
#: Queries whose nearest are found by a scan too, the share of these that walks must find, and queries of a block of a scan.
MEASURED, TARGET, SCAN = 64, 0.91, 1024
#: Nodes at most that every walk starts at besides its own, those of the largest norms from this multiple of the median.
ENTRIES, RARE = 32, 2.0
log = logging.getLogger(__name__)
_LISTS = "ids array<long>, sims array<float>"
_SPAN = 65_536


def _list(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the size of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _parts(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms of n halves."""
    raw = np.frombuffer(data, np.float16).reshape(n, -1)
    return raw[:, :-2].astype(np.float32), np.ascontiguousarray(raw[:, -2:]).view(np.float32)[:, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    """Directions of halves as rows."""
    return _parts(b"".join(column.to_pylist()), len(column))[0] if len(column) else np.zeros((0, 1), np.float32)


def _groups(batches, least: int = 4096):
    """Batches of whole groups of the first column, by which the rows come sorted."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column(0).to_numpy()
            end = int(np.searchsorted(keys, keys[-1], "left"))
            if end:
                yield whole.slice(0, end).combine_chunks().to_batches()[0]
                whole, n = whole.slice(end), n - end
            held = whole.to_batches()
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _first(order_keys: list[np.ndarray], group: np.ndarray, most: int) -> np.ndarray:
    """Rows in order of group and then the keys, at most `most` of each group."""
    order = np.lexsort((*order_keys[::-1], group))
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < most]


def _half(vectors: DataFrame, norm: float) -> DataFrame:
    """node, half binary: the direction in half precision, then the norm as a share of the largest in single precision."""

    def run(batches):
        for batch in batches:
            flat, _ = _flat(batch.column(1))
            x = flat.astype(np.float64).reshape(batch.num_rows, -1)
            x, most = x / np.abs(x).max(1, keepdims=True), np.abs(x).max(1)
            size = np.linalg.norm(x, axis=1)
            half, share = (x / size[:, None]).astype(np.float16), (size * (most / norm)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() + s.tobytes() for r, s in zip(half, share, strict=True)], pa.binary())], names=["node", "half"])

    return in_arrow(vectors.select("node", "vector"), run, "node long, half binary")


def _start(half: DataFrame, dims: int, bits: int, k: int) -> DataFrame:
    """Neighbour lists from blocks of rows that stand side by side in the order of their hyperplane signs."""

    def keyed(batches):
        planes = np.random.default_rng(11).standard_normal((TABLES, dims, bits))
        for batch in batches:
            x = _matrix(batch.column(1))
            for t in range(TABLES):
                key = ((x @ planes[t] > 0) << np.arange(bits)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(key, pa.int64()), batch.column(0), batch.column(1)], names=["t", "key", "node", "half"])

    def blocks(batches):
        for batch in _groups(batches, _SPAN):  # whole tables or parts of them, cut to blocks in order
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                node, x = part.column(2).to_numpy(), _matrix(part.column(3))
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                m = min(k, len(node) - 1)
                if m < 1:
                    continue
                near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                size = np.full(len(node), m)
                yield pa.RecordBatch.from_arrays([part.column(2), _list(node[near].ravel(), size, pa.int64()), _list(np.take_along_axis(s, near, 1).ravel(), size, pa.float32())], names=["node", "ids", "sims"])

    rows = in_arrow(half, keyed, "t int, key long, node long, half binary")
    spread = rows.repartitionByRange("t", "key", "node").sortWithinPartitions("t", "key", "node")
    return in_arrow(spread, blocks, f"node long, {_LISTS}")


def _merged(held: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """The k nearest of held (node, half, ids, sims) and proposed lists, fresh where they were not held."""

    def run(batches):
        for b in _groups(batches):
            node, old = b.column(0).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            ids, size = _flat(b.column(2))
            sims, _ = _flat(b.column(3))
            row = np.repeat(np.arange(len(node)), size)
            fresh = ~old[row]
            own = ids != node[row]
            row, ids, sims, fresh = row[own], ids[own], sims[own], fresh[own]
            one = _first([fresh, -sims], np.unique(node[row], return_inverse=True)[1].astype(np.int64) * (1 << 32) + np.unique(ids, return_inverse=True)[1], 1)
            row, ids, sims, fresh = row[one], ids[one], sims[one], fresh[one]
            best = _first([-sims, ids], node[row], k)
            row, ids, sims, fresh = row[best], ids[best], sims[best], fresh[best]
            mine = np.flatnonzero(old)  # the row of each node that brings its vector
            at = np.searchsorted(node[mine], node[row])
            size = np.bincount(at, minlength=len(mine))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(mine)), b.column(1).take(pa.array(mine)), _list(ids, size, pa.int64()), _list(sims, size, pa.float32()), _list(fresh, size, pa.bool_())], names=["node", "half", "ids", "sims", "fresh"]
            )

    own = held.select("node", "half", "ids", "sims", F.lit(True).alias("old"))
    new = lists.select("node", F.lit(None).cast("binary").alias("half"), "ids", "sims", F.lit(False).alias("old"))
    rows = own.unionByName(new).repartition("node").sortWithinPartitions("node")
    return in_arrow(rows, run, f"node long, half binary, {_LISTS}, fresh array<boolean>")


def _meetings(graph: DataFrame, k: int, turn: int) -> DataFrame:
    """dest, member, fresh, half, least: the neighbours of each node and a sample of k reverse ones, with their vectors."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("to"), F.col("e.fresh").alias("fresh"))
    back = edges.select(F.col("to").alias("dest"), F.col("node").alias("member"), "fresh")
    by = Window.partitionBy("dest").orderBy(F.desc("fresh"), F.xxhash64("dest", "member", F.lit(turn)))
    back = back.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).drop("rank")
    pairs = edges.select(F.col("node").alias("dest"), F.col("to").alias("member"), "fresh").unionByName(back)
    pairs = pairs.groupBy("dest", "member").agg(F.max("fresh").alias("fresh"))
    # A node with fewer than k neighbours takes any.
    least = F.when(F.size("sims") < k, F.lit(-9.0).cast("float")).otherwise(F.array_min("sims"))
    return pairs.join(graph.select(F.col("node").alias("member"), "half", least.alias("least")), "member").select("dest", "member", "fresh", "half", "least")


def _proposals(meetings: DataFrame) -> DataFrame:
    def run(batches):
        for b in _groups(batches):
            dest, member = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh, x, least = b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(3)), b.column(4).to_numpy()
            start = np.concatenate([[0], np.flatnonzero(dest[1:] != dest[:-1]) + 1, [len(dest)]])
            who, ids, sims, sizes = [], [], [], []
            for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                f = fresh[lo:hi]
                if hi - lo < 2 or not f.any():
                    continue
                s = x[lo:hi] @ x[lo:hi].T
                s[~(f[:, None] | f)] = -np.inf
                np.fill_diagonal(s, -np.inf)
                m = min(PROPOSALS, hi - lo - 1)
                near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                got = np.take_along_axis(s, near, 1)
                ok = got > least[lo:hi, None]
                who.append(member[lo:hi])
                ids.append(member[lo + near[ok]])
                sims.append(got[ok])
                sizes.append(ok.sum(1))
            if who:
                size = np.concatenate(sizes)
                some = size > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)[some], pa.int64()), _list(np.concatenate(ids), size[some], pa.int64()), _list(np.concatenate(sims), size[some], pa.float32())], names=["node", "ids", "sims"])

    rows = meetings.repartition("dest").sortWithinPartitions("dest")
    return in_arrow(rows, run, f"node long, {_LISTS}")


def build_graph(vectors: DataFrame, norm: float, dims: int, count: int, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """node, half, ids, sims, fresh: the k nearest nodes found for each of the vectors (node, vector)."""
    half = cut(_half(vectors, norm), "ann-half")
    none = half.select("node", "half", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"))
    bits = max(1, min(40, math.ceil(math.log2(max(2, count / 64)))))
    graph = cut(_merged(none, _start(half, dims, bits, k), k), "ann-graph")
    for turn in range(rounds):
        met = _meetings(graph, k, turn)
        graph = cut(_merged(graph, _proposals(met), k), "ann-graph")
        fresh = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        graph.sparkSession.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the round before
        if fresh <= SETTLED * count * k:
            break
    return graph


def _opened(graph: DataFrame, k: int) -> str:
    """A table, bucketed by node, of each node's neighbours both ways with their vectors; the name of it."""

    def run(batches):
        for b in _groups(batches):
            dest, member, data = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            start = np.concatenate([[0], np.flatnonzero(dest[1:] != dest[:-1]) + 1, [len(dest)]])
            halves = [b"".join(data[lo:hi]) for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(dest[start[:-1]], pa.int64()), _list(member, np.diff(start), pa.int64()), pa.array(halves, pa.binary())], names=["node", "ids", "halves"])

    spark = graph.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_arrow(_meetings(graph, k, 0).repartition(n, "dest").sortWithinPartitions("dest"), run, "node long, ids array<long>, halves binary")
    name = f"ann_{uuid.uuid4().hex}"
    rows.repartition(n, "node").write.bucketBy(n, "node").sortBy("node").saveAsTable(name)
    return name


def _walked(opened: DataFrame) -> DataFrame:
    """Sims of each query (q, half) with the neighbours of the node that it opens."""

    def run(batches):
        for b in batches:
            ids, size = _flat(b.column(2))
            sims = []
            for h, block in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, norms = _parts(block, len(block) // len(h))
                sims.append(x @ _parts(h, 1)[0][0] * norms)
            yield pa.RecordBatch.from_arrays([b.column(0), _list(ids, size, pa.int64()), _list(np.concatenate(sims) if sims else np.zeros(0), size, pa.float32())], names=["q", "ids", "sims"])

    return in_arrow(opened.select("q", "half", "ids", "halves"), run, f"q long, {_LISTS}")


def _beams(held: DataFrame | None, found: DataFrame, beam: int, opened: int) -> DataFrame:
    """q, half, ids, sims, open: the nearest nodes of each query, those to open next being marked 1, opened ones 2."""

    def run(batches):
        for b in _groups(batches, 2048):
            q = b.column(0).to_numpy()
            ids, size = _flat(b.column(2))
            sims, _ = _flat(b.column(3))
            state, _ = _flat(b.column(4))
            row = np.repeat(np.arange(len(q)), size)
            one = _first([-state, -sims], np.unique(q[row], return_inverse=True)[1].astype(np.int64) * (1 << 32) + np.unique(ids, return_inverse=True)[1], 1)
            row, ids, sims, state = row[one], ids[one], sims[one], np.where(state[one] > 0, 2, 0)
            best = _first([-sims, ids], q[row], beam)
            row, ids, sims, state = row[best], ids[best], sims[best], state[best]
            todo = np.flatnonzero(state == 0)
            state[todo[_first([-sims[todo], ids[todo]], q[row[todo]], opened)]] = 1
            mine = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
            at = np.searchsorted(q[mine], q[row])
            size = np.bincount(at, minlength=len(mine))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine)), b.column(1).take(pa.array(mine)), _list(ids, size, pa.int64()), _list(sims, size, pa.float32()), _list(state, size, pa.int32())], names=["q", "half", "ids", "sims", "open"])

    new = found.select("q", F.lit(None).cast("binary").alias("half"), "ids", "sims", F.transform("ids", lambda _: F.lit(0)).alias("open"))
    rows = held.unionByName(new).repartition("q").sortWithinPartitions("q")
    return in_arrow(rows, run, f"q long, half binary, {_LISTS}, open array<int>")


def _started(asked: DataFrame, entries: list[tuple[int, bytes]]) -> DataFrame:
    """First beams of the query nodes (node, half): themselves, and the entries with their sims."""
    nodes, halves = np.array([n for n, _ in entries], np.int64), b"".join(h for _, h in entries)

    def run(batches):
        for b in batches:
            q = b.column(0).to_numpy()
            x = _matrix(b.column(1))
            ids, sims = q[:, None], np.full((len(q), 1), -9.0, np.float32)
            if len(nodes) and len(q):
                y, norms = _parts(halves, len(nodes))
                ids, sims = np.concatenate([ids, np.tile(nodes, (len(q), 1))], 1), np.concatenate([sims, x @ y.T * norms], 1)
            size = np.full(len(q), ids.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list(ids.ravel(), size, pa.int64()), _list(sims.ravel(), size, pa.float32()), _list(np.ones(ids.size), size, pa.int32())], names=["q", "half", "ids", "sims", "open"])

    return in_arrow(asked.select("node", "half"), run, f"q long, half binary, {_LISTS}, open array<int>")


def search(graph: DataFrame, index: str, queries: DataFrame, entries: list[int], walk: tuple[int, int, int]) -> DataFrame:
    """q, cand: the nodes that each query node (column q) holds at the end of its walk from itself and the entries.

    index: the table that _opened() wrote; walk: one of WALKS.
    """
    beam, opened, hops = walk
    table = graph.sparkSession.table(index)
    first = [(r[0], bytes(r[1])) for r in graph.filter(F.col("node").isin(list(entries))).select("node", "half").collect()] if entries else []
    state = cut(_started(graph.join(queries.select(F.col("q").alias("node")).distinct(), "node"), first), "ann-beams")
    for _ in range(hops):
        front = state.select("q", "half", F.explode(F.arrays_zip("ids", "open")).alias("e")).filter("e.open = 1").select("q", "half", F.col("e.ids").alias("node"))
        state = cut(_beams(state, _walked(front.join(table, "node")), beam, opened), "ann-beams")
        graph.sparkSession.sparkContext._jvm.System.gc()
        if not state.filter(F.array_contains("open", 1)).limit(1).count():
            break
    return state.select("q", F.explode("ids").alias("cand")).filter("q != cand")


def scanned(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, cand, score: the k nearest nodes (node, vector) of each query node (q) by a scan of all, the node itself too.

    Queries are sent to all tasks in blocks of bounded size; of each batch of nodes only the k nearest go on.
    """
    spark = nodes.sparkSession
    asked = cut(nodes.join(queries.select(F.col("q").alias("node")).distinct(), "node").select(F.col("node").alias("q"), F.col("vector").alias("x")), "ann-scan")
    blocks = -(-asked.count() // SCAN)
    out = None
    for i in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()
        q = mine["q"].to_numpy()
        if not len(q):
            continue
        x = _flat(mine["x"].combine_chunks())[0].astype(np.float64).reshape(len(q), -1)
        sent = spark.sparkContext.broadcast((q, x))

        def run(batches, sent=sent):
            q, x = sent.value
            for b in batches:
                node = b.column(0).to_numpy()
                s = _flat(b.column(1))[0].astype(np.float64).reshape(len(node), -1) @ x.T
                m = min(k, len(node))
                near = np.argpartition(-s, m - 1, axis=0)[:m]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(q, m)), pa.array(node[near].ravel()), pa.array(np.take_along_axis(s, near, 0).ravel())], names=["q", "cand", "score"])

        rows = in_arrow(nodes.select("node", "vector"), run, "q long, cand long, score double")
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cand"))
        part = cut(rows.withColumn("place", best).filter(F.col("place") <= k).drop("place"), "ann-scanned")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "q long, cand long, score double")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the nearest nodes (truth: q, cand, score) that found (q, cand) has, a node like the farthest counts as it."""
    hit = truth.join(found.select("q", "cand").distinct().withColumn("hit", F.lit(1)), ["q", "cand"], "left")
    r = hit.agg(F.count(F.lit(1)), F.sum(F.coalesce("hit", F.lit(0)))).first()
    return r[1] / r[0] if r[0] else 1.0


def walked(nodes: DataFrame, graph: DataFrame, asked: DataFrame, entries: list[int], top: int) -> DataFrame:
    """q, cand of all query nodes: by walks that find TARGET of the nearest of MEASURED queries, else by scans."""
    some = cut(asked.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(MEASURED), "ann-measured")
    truth = scanned(nodes, some, top + 1).filter("q != cand")
    index = _opened(graph, NEIGHBOURS)
    try:
        for walk in WALKS:
            found = search(graph, index, asked, entries, walk)
            share = recall(found.join(some, "q"), truth)
            log.info("walks with %s find %.3f of the nearest of %s queries", walk, share, MEASURED)
            if share >= TARGET:
                return found
    finally:
        graph.sparkSession.sql(f"DROP TABLE IF EXISTS {index}")
    return scanned(nodes, asked, top + 1).select("q", "cand").filter("q != cand")


def _exact(pairs: DataFrame) -> DataFrame:
    """q, cand, score: inner products in double precision of the vectors x and y."""

    def run(batches):
        for b in batches:
            x, y = (_flat(b.column(i))[0].astype(np.float64).reshape(b.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(1), pa.float64())], names=["q", "cand", "score"])

    return in_arrow(pairs.select("q", "cand", "x", "y"), run, "q long, cand long, score double")


def nearest(rows: DataFrame, every: int = 20, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col, score: the `top` nearest found of each row whose id is divisible by `every`.

    Nearness is the largest inner product of the original vectors in double precision, ties to the smaller id. Rows
    with a null id, a null or zero vector, a null or non-finite component, or fewer components than the longest take no
    part. Equal vectors are one node but all are candidates: of each node the top + 1 smallest ids can matter. A row is
    never its own candidate, nor are rows that repeat its id. With fewer candidates all found are returned; an empty
    table gives no rows. Extra columns are ignored. Walks that find less than TARGET of the nearest are widened, in the
    end to a scan, so recall on what is measured does not depend on the data.
    """
    v = F.col("vector")
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(
        "id IS NOT NULL AND vector IS NOT NULL"
    ).filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    held = cut(held.select("id", "vector", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), F.aggregate(v, F.lit(0.0), lambda n, x: n + x * x).alias("sq")), "ann-rows")
    dims = held.agg(F.max(F.size("vector"))).first()[0] or 0
    held = held.filter(F.size("vector") == dims)
    most, middle = held.agg(F.max("sq"), F.percentile_approx("sq", 0.5)).first()
    norm = math.sqrt(most or 1.0) or 1.0
    by = Window.partitionBy("h1", "h2").orderBy("id")
    ranked = held.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top + 1)
    nodes = cut(ranked.filter("rank = 1").select(F.col("id").alias("node"), "h1", "h2", "vector", "sq"), "ann-nodes")
    members = ranked.select("id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "id")
    asked = cut(held.filter(F.pmod("id", F.lit(every)) == 0).select("id", "h1", "h2").distinct().join(nodes.select("h1", "h2", F.col("node").alias("q")), ["h1", "h2"]).select(F.col("id").alias("query_id"), "q"), "ann-asked")
    graph = build_graph(nodes, norm, dims, nodes.count())
    large = nodes.filter(F.col("sq") > RARE**2 * (middle or 0.0)).orderBy(F.desc("sq"), "node").limit(ENTRIES)
    found = walked(nodes, graph, asked, [r[0] for r in large.select("node").collect()], top)
    found = found.unionByName(asked.select("q", F.col("q").alias("cand")).distinct())
    of = lambda name, col: nodes.select(F.col("node").alias(name), F.col("vector").alias(col))
    scored = cut(_exact(found.join(of("cand", "y"), "cand").join(of("q", "x"), "q")), "ann-scored")
    # Only members of the best top + 1 nodes can be among the top rows.
    near = scored.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cand"))).filter(F.col("place") <= top + 1)
    near = near.select("q", "score", F.col("cand").alias("node")).join(members, "node").select("q", "score", "id")
    # A query row of a node needs the node's best top + 1 rows, however many rows share the node.
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= top + 1)
    out = asked.join(near, "q").filter("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(id_col), "score")
