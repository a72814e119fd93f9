"""Exact top-k search by inner product, with a KD-tree for each shard."""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


SHARDS = 1 << 15  # so many boxes can be sent to every task


class Tree:
    """Median splits along the widest side, with the tight box of each node; leaves hold ``leaf`` rows at most."""

    def __init__(self, points: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        todo = [(self._node(points, 0, len(points)), 0, len(points))]
        while todo:
            node, a, b = todo.pop()
            if b - a > leaf and (self.high[node] > self.low[node]).any():
                side = int((self.high[node] - self.low[node]).argmax())
                mid = (a + b) // 2
                rows = self.order[a:b]
                self.order[a:b] = rows[np.argpartition(points[rows, side], mid - a)]
                left, right = self._node(points, a, mid), self._node(points, mid, b)
                self.children[node] = (left, right)
                todo += [(left, a, mid), (right, mid, b)]
        self.points = points[self.order]
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _node(self, points: np.ndarray, a: int, b: int) -> int:
        rows = points[self.order[a:b]]
        self.low.append(rows.min(axis=0))
        self.high.append(rows.max(axis=0))
        self.span.append((a, b))
        self.children.append(None)
        return len(self.span) - 1

    def top(self, query: np.ndarray, own: int, ids: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows that score ``kth`` or more, best box first, until no box that was opened or left closed reaches the k-th score.

        ``ids`` are in the tree's order; ties go to smaller ones, and rows with the query's own id take no part.
        """
        scores, found = np.zeros(0, self.points.dtype), np.zeros(0, np.int64)
        heap = [(-self.bound(query, [0])[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            inner = self.children[node]
            if inner:
                for child, bound in zip(inner, self.bound(query, inner), strict=True):
                    if bound >= kth:
                        heapq.heappush(heap, (-bound, child))
                continue
            a, b = self.span[node]
            s = self.points[a:b] @ query
            good = (s >= kth) & (ids[a:b] != own)
            if good.any():
                scores, found = np.r_[scores, s[good]], np.r_[found, ids[a:b][good]]
                if len(scores) > k:
                    best = np.lexsort((found, -scores))[:k]
                    scores, found = scores[best], found[best]
                if len(scores) == k:
                    kth = max(kth, scores.min())
        return found, scores

    def as_floats(self) -> Tree:
        other = copy.copy(self)
        other.points, other.lows, other.highs = (x.astype(np.float64) for x in (self.points, self.lows, self.highs))
        return other

    def bound(self, query: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        """The highest product with the query that a point in each node's box can have."""
        nodes = list(nodes)
        return np.maximum(query * self.lows[nodes], query * self.highs[nodes]).sum(axis=1)


def integers(embedding: Column) -> Column:
    """floor(1024 x) of each component as a double; null where the vector, or a component, is null or not finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * 1024)))


def splits(sample: np.ndarray, parts: int) -> list[tuple[int, int, float]]:
    """Median splits of a sample along its widest sides, into ``parts`` parts or fewer: (node, side, value); node n has the children 2n + 1 (up to the value) and 2n + 2."""
    found, todo = [], [(0, sample, parts)]
    while todo:
        node, rows, n = todo.pop()
        if n < 2 or len(rows) < 2:
            continue
        side = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
        value = float(np.sort(rows[:, side])[(len(rows) - 1) // 2])
        low = rows[:, side] <= value
        if low.all():
            continue
        found.append((node, side, value))
        todo += [(2 * node + 1, rows[low], n - n // 2), (2 * node + 2, rows[~low], n // 2)]
    return found


def leaves(points: np.ndarray, tree: list[tuple[int, int, float]]) -> np.ndarray:
    """The node in which each point ends."""
    last = max((n for n, _, _ in tree), default=0)
    side, value = np.full(2 * last + 3, -1), np.zeros(2 * last + 3)
    for n, s, x in tree:
        side[n], value[n] = s, x
    node = np.zeros(len(points), np.int64)
    while True:
        rows = np.flatnonzero(side[node] >= 0)
        if not len(rows):
            return node
        here = node[rows]
        node[rows] = 2 * here + 1 + (points[rows, side[here]] > value[here])


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sharded(rows: DataFrame, shard_rows: int, sample_rows: int) -> DataFrame:
    """``rows`` with ``leaf`` and ``part``: shards of about ``shard_rows`` rows, or more where there would be more than SHARDS, that lie close together.

    The splits are those of a sample of about ``sample_rows`` rows, chosen by hash, for each length of vectors; a leaf that still has too many rows, such as
    equal vectors that no split parts, is dealt to parts by hash.
    """
    n = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shard_rows = max(shard_rows, -(-sum(n.values()) // SHARDS))
    every = max(1, sum(n.values()) // sample_rows)
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(every)) == 0).select("dim", "v").toArrow()
    dims = some["dim"].to_numpy()
    trees = {d: splits(matrix(some["v"].take(pa.array(np.flatnonzero(dims == d))), d).astype(np.float64), -(-n[d] // shard_rows)) for d in np.unique(dims).tolist()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            leaf = np.zeros(len(dims), np.int64)
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                leaf[here] = leaves(matrix(batch.column("v").take(pa.array(here)), d), trees.get(d, []))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    placed = common.stash(rows.mapInArrow(place, "vec_id long, v array<bigint>, dim int, is_query boolean, leaf long"), "placed")
    sizes = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    # there are SHARDS leaves at most, and as many parts more
    return placed.join(F.broadcast(sizes), ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 8192, sample_rows: int = 16384) -> DataFrame:
    """The ``k`` rows of the highest integer inner product with each query: query_id, rank, vec_id, score; ties to smaller vec_id.

    Rows are dealt to shards that lie close together, each a KD-tree built once for all queries that pass through it, batch by batch.  A query first searches its own
    shard, which also tells its box; the query's k-th score there is the floor below which neither other shards nor boxes in them
    are opened.  Scores are 64-bit integers.  Vectors of different lengths are not compared.  Rows without vec_id, vector or finite
    components take no part; rows that repeat a query's vec_id count as its own row (the smallest vector is searched), rows that repeat another
    are each a row.  An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = common.stash(rows.where("vec_id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v")), "vectors")
    rows = common.stash(sharded(rows.select("vec_id", "v", "dim", "is_query"), shard_rows, sample_rows), "shards")
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min(F.struct("v", "dim", "leaf", "part")).alias("x")).select("vec_id", "x.*")
    queries = common.stash(queries, "queries")
    keys = ["dim", "leaf", "part"]

    def search(boxes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of rows sorted by shard and role (0: a vector, 1: a query), each query's best; with ``boxes`` also a row (null, null, null) with each shard's box."""
        names = ["query_id", "vec_id", "score", *keys, "low", "high"]
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held, tree = None, [], None
            for batch in batches:
                out: list[tuple] = []
                for part in common.sorted_groups(iter([batch]), [*keys, "role"]):
                    here = tuple(part[c][0].as_py() for c in keys)
                    if here != shard:
                        shard, held, tree = here, [], None
                    if part["role"][0].as_py() == 0:
                        held.append(part)
                        continue
                    if not held and tree is None:
                        continue
                    wanted = matrix(part["v"], shard[0])
                    if tree is None:
                        table = pa.concat_tables(held)
                        points = matrix(table["v"], shard[0])
                        tree, held = Tree(points), []
                        ids = table["vec_id"].to_numpy()[tree.order]
                        if boxes:
                            out.append((None, None, None, *shard, tree.lows[0].tolist(), tree.highs[0].tolist()))
                        # as floats, which are faster, where all sums are exact so
                        most = float(np.abs(points).max(initial=0))
                        whole, exactly = tree, tree.as_floats()
                    fits = most * float(np.abs(wanted).max(initial=0)) * shard[0] < 2**53
                    tree, own, floor = exactly if fits else whole, part["vec_id"].to_pylist(), part["floor"].to_pylist()
                    for q, row in enumerate(wanted.astype(np.float64) if fits else wanted):
                        found, scores = tree.top(row, own[q], ids, k, floor[q])
                        out += [(own[q], i, int(s), *shard, None, None) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        return run

    def searched(asked: DataFrame, boxes: bool) -> DataFrame:
        held = rows.select(*keys, F.lit(0).alias("role"), "vec_id", "v", F.lit(0).cast("long").alias("floor"))
        both = held.unionByName(asked.select(*keys, F.lit(1).alias("role"), "vec_id", "v", "floor"))
        both = both.repartition(*keys).sortWithinPartitions(*keys, "role")
        return both.mapInArrow(search(boxes), "query_id long, vec_id long, score long, dim int, leaf long, part int, low array<bigint>, high array<bigint>")

    lowest = F.lit(-(1 << 62))
    first = common.stash(searched(queries.withColumn("floor", lowest), True), "home")
    home = first.where("query_id is not null").select("query_id", "vec_id", "score")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("floor"))
    asked = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("floor", lowest)).drop("query_id")
    # all shards but the query's own whose box can reach the floor; a shard without queries of its own has told no box, and is asked by all
    told = first.where("query_id is null").select(*keys, "low", "high")
    known = rows.select(*keys).distinct().join(told, keys, "left").select(F.col("dim").alias("d"), F.col("leaf").alias("to"), F.col("part").alias("to_part"), "low", "high")
    known = common.stash(known, "boxes")
    # as doubles, which never overflow, and a little more than the bound, so that no rounding closes a shard
    term = "greatest(double(x) * y.a, double(x) * y.b)"
    best = f"aggregate(zip_with(v, zip_with(low, high, (a, b) -> named_struct('a', a, 'b', b)), (x, y) -> {term}), double(0), (s, t) -> s + t + abs(t) * 1e-9)"
    reach = F.expr(f"dim = d and not (leaf = to and part = to_part) and (low is null or {best} >= floor)")
    asked = asked.join(F.broadcast(known), reach).select("dim", F.col("to").alias("leaf"), F.col("to_part").alias("part"), "vec_id", "v", "floor")
    found = home.unionByName(searched(common.stash(asked, "asked"), False).select("query_id", "vec_id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
