"""Approximate nearest neighbours with a vantage-point tree for each shard.

Some vectors, one for each shard, are pivots, and every vector lies in the shard of its nearest pivot; a shard that
would be large is cut by a hash of the id. Each shard becomes a tree: a vantage point, the median of the distances to it,
and a subtree for each half; a leaf holds up to ``LEAF`` vectors. A search goes into the half that the query lies in
first, and into the other only if the triangle inequality leaves room there for something nearer than the k-th best so
far. That bound is relaxed by ``factor``: the other half is left out if ``factor`` times the distance to the border exceeds
the k-th best. Factor one prunes by the inequality itself and is exact.

A query first searches the shard that it lies in. With its k-th best from there it visits only shards that the same
inequality, relaxed by the same factor, leaves room in: a shard's vectors are no nearer than the distance to its pivot
less its radius, and no nearer than half the difference of the distances to its pivot and the query's own.

Blocks of queries go through the shards one after another: a task holds one shard and one block. Each shard gives k
rows a query, and a window keeps the k best. Distances are computed in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.session import stored

LEAF = 256
SHARD_ROWS = 20_000
QUERY_BLOCK = 512
# Pivots travel to every task; with more vectors than these times SHARD_ROWS, shards are cut by hash.
MAX_PIVOTS = 4096
VECTOR, QUERY = 0, 1


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # nodes by number: rows of a leaf, or vantage row, median and children
        self.nodes: list[tuple] = []
        todo, self.root = [(np.arange(len(ids)), None)], 0
        while todo:
            rows, parent = todo.pop()
            number = len(self.nodes)
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = number
            if len(rows) <= LEAF:
                self.nodes.append(rows)
                continue
            # the first row of a shard is as good as any: ids are in order of a hash
            vantage, rest = rows[0], rows[1:]
            d = distances(vectors[rest], vectors[vantage])
            half = len(rest) // 2
            order = np.argpartition(d, half)
            # equal distances may lie on both sides; the border belongs to both
            self.nodes.append([vantage, float(d[order[half]]), -1, -1])
            todo += [(rest[order[:half]], (number, 2)), (rest[order[half:]], (number, 3))]

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, factor: float, bound: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found for each query within its ``bound``, nearest first; missing ones
        have the id ``NONE``."""
        best = Best(len(queries), k, bound)
        self._visit(self.root, np.arange(len(queries)), queries, names, best, factor)
        return best.ids, best.distance

    def _offer(self, rows: np.ndarray, who: np.ndarray, queries, names, best: Best) -> None:
        """Measures the rows that may be among the k best of a query, by a matrix product with room for rounding."""
        x, q = self.vectors[rows], queries[who]
        norms = np.square(x).sum(axis=1) + np.square(q).sum(axis=1)[:, None]
        rough = norms - 2 * (q @ x.T)
        border = np.square(best.distance[who, -1:])
        # the product is off by parts of the norms, however near the vectors are to each other
        near = (rough <= border * (1 + 1e-9) + (x.shape[1] + 8) * 1e-15 * norms) & (self.ids[rows][None, :] != names[who][:, None])  # not its own row
        some = np.flatnonzero(near.any(axis=1))
        for i in some.tolist():
            chosen = rows[near[i]]
            best.add(who[i], self.ids[chosen], distances(self.vectors[chosen], q[i]))

    def _visit(self, node: int, who: np.ndarray, queries, names, best: Best, factor: float) -> None:
        if not len(who):
            return
        content = self.nodes[node]
        if isinstance(content, np.ndarray):
            if len(content):
                self._offer(content, who, queries, names, best)
            return
        vantage, median, inner, outer = content
        d = distances(queries[who], self.vectors[vantage])
        self._offer(np.array([vantage]), who, queries, names, best)
        near = d <= median
        self._visit(inner, who[near], queries, names, best, factor)
        self._visit(outer, who[~near], queries, names, best, factor)
        # what lies beyond the border is at least this far away
        room = factor * (np.abs(d - median) - 1e-14 * (d + median)) <= best.distance[who, -1]
        self._visit(outer, who[near & room], queries, names, best, factor)
        self._visit(inner, who[~near & room], queries, names, best, factor)


NONE = np.iinfo(np.int64).max


class Best:
    """The k nearest so far for each query, ties to the smaller id; places that nothing has are at the bound."""

    def __init__(self, queries: int, k: int, bound: np.ndarray | float):
        self.ids = np.full((queries, k), NONE)
        self.distance = np.empty((queries, k))
        self.distance[:] = np.reshape(bound, (-1, 1))

    def add(self, who: int, ids: np.ndarray, distance: np.ndarray) -> None:
        k = self.ids.shape[1]
        all_d, all_i = np.concatenate((self.distance[who], distance)), np.concatenate((self.ids[who], ids))
        order = np.lexsort((all_i, all_d))[:k]
        self.distance[who], self.ids[who] = all_d[order], all_i[order]


def distances(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed component by component in one fixed order."""
    return np.sqrt(np.square(vectors - point).sum(axis=-1))


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([distances(x, p) for p in pivots], axis=1)


def vectors_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def placed(pivots: np.ndarray):
    """Adds the nearest pivot of each vector and the distance to it."""

    def run(batches):
        for batch in batches:
            d = pivot_distances(vectors_of(batch, pivots.shape[1]), pivots)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], names=[*batch.schema.names, "pivot", "far"]
            )

    return run


def room(x: np.ndarray, own: np.ndarray, bound: np.ndarray, pivots: np.ndarray, radius: np.ndarray, factor: float) -> np.ndarray:
    """True for each query and pivot whose shard may hold something within the query's bound."""
    d = pivot_distances(x, pivots)
    least = np.maximum(d - radius, (d - d[np.arange(len(x)), own][:, None]) / 2)
    return factor * (least - 1e-12 * (d + radius)) <= bound[:, None]


def visiting(pivots: np.ndarray, radius: np.ndarray, factor: float):
    """One row for each query and each other pivot whose shard it has to visit."""

    def run(batches):
        for batch in batches:
            x, own = vectors_of(batch, pivots.shape[1]), batch.column("pivot").to_numpy(zero_copy_only=False)
            visit = room(x, own, batch.column("bound").to_numpy(zero_copy_only=False), pivots, radius, factor)
            visit[np.arange(len(x)), own] = False
            who, pivot = np.nonzero(visit)
            taken = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("vector"), taken.column("bound"), pa.array(pivot.astype(np.int32))], names=["id", "vector", "bound", "pivot"])

    return run


def searched(k: int, factor: float, width: int):
    """Reads the rows of one shard after another, vectors before queries; holds one tree and one block."""

    def run(batches):
        shard, ids, vectors, tree = None, [], [], None
        names, points, bounds = [], [], []

        def flush():
            nonlocal names, points, bounds
            if names and tree is not None:
                q = np.array(names)
                found, d = tree.search(np.array(points), q, k, factor, np.array(bounds))
                there = found != NONE
                who = np.repeat(q, k).reshape(d.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[there]), pa.array(found[there]), pa.array(d[there])], names=["query_id", "vec_id", "score"]
                )
            names, points, bounds = [], [], []

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "id", "bound")]
            values = vectors_of(batch, width)
            new = np.flatnonzero(C.starts(*columns[:2]))
            for first, last in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                if columns[0][first] != shard:
                    yield from flush()
                    shard, ids, vectors, tree = columns[0][first], [], [], None
                if columns[1][first] == VECTOR:
                    ids.append(columns[2][first:last])
                    vectors.append(values[first:last])
                    continue
                if tree is None and ids:
                    tree = Tree(np.concatenate(ids), np.concatenate(vectors))
                for at in range(first, last, QUERY_BLOCK):
                    block = slice(at, min(at + QUERY_BLOCK, last))
                    names += columns[2][block].tolist()
                    points += list(values[block])
                    bounds += columns[3][block].tolist()
                    if len(names) >= QUERY_BLOCK:
                        yield from flush()
        yield from flush()

    return run


def _in_shards(own: DataFrame, asked: DataFrame, shards: DataFrame, k: int, factor: float, width: int) -> DataFrame:
    """``query_id, vec_id, score``: what the queries ``id, vector, bound, pivot`` find in the shards of their pivots."""
    spark = own.sparkSession
    cut = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    vectors = own.join(shards, "pivot").select((F.col("first") + cut).alias("shard"), F.lit(VECTOR).alias("kind"), "id", "vector", F.lit(0.0).alias("bound"))
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard")
    queries = asked.join(shards, "pivot").select(each, F.lit(QUERY).alias("kind"), "id", "vector", "bound")
    dealt = vectors.union(queries).repartition(C.shuffle_partitions(spark), "shard")
    ordered = dealt.sortWithinPartitions("shard", "kind", F.xxhash64("id"))
    return ordered.mapInArrow(searched(k, factor, width), "query_id long, vec_id long, score double")


def _nearest_of_width(same: DataFrame, n: int, width: int, k: int, factor: float, shard_rows: int) -> DataFrame:
    wanted = min(MAX_PIVOTS, -(-n // shard_rows))
    some = same.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(wanted).select("vector").collect()
    pivots = np.array([r["vector"] for r in some])
    own = stored(same.select("id", "q", "vector").mapInArrow(placed(pivots), "id long, q boolean, vector array<double>, pivot int, far double"))
    # at most as many rows as pivots
    sizes = own.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("pivot").collect()
    radius, first, rows = np.zeros(len(pivots)), 0, []
    for r in sizes:
        parts = -(-r["n"] // shard_rows)
        radius[r["pivot"]] = r["far"]
        rows.append((r["pivot"], first, parts))
        first += parts
    shards = F.broadcast(own.sparkSession.createDataFrame(rows, "pivot int, first int, parts int"))
    asked = own.where("q").select("id", "vector", F.lit(float("inf")).alias("bound"), "pivot")
    near = stored(_in_shards(own, asked, shards, k, factor, width))
    if len(rows) == 1:
        return near
    # k rows for each part of the query's own shard
    kth = F.get(F.sort_array(F.collect_list("score")), k - 1)
    bounds = near.groupBy("query_id").agg(kth.alias("kth"))
    again = own.where("q").join(bounds, F.col("id") == F.col("query_id"), "left").select("id", "vector", F.coalesce("kth", F.lit(float("inf"))).alias("bound"), "pivot")
    others = again.mapInArrow(visiting(pivots, radius, factor), "id long, vector array<double>, bound double, pivot int")
    return near.union(_in_shards(own, others, shards, k, factor, width))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found among all other rows for each row with ``is_query``.

    Vectors that are null, zero or hold a null or non-finite component take no part, and neither do rows with a null
    id. Vectors must have one length; those of another length than most short of none are an error of the caller, so
    rows are searched among rows of their own length. Fewer candidates than ``k`` are all returned. Rows that repeat
    an id are one row if their vectors agree; otherwise the one with the smaller vector counts. Ties go to the smaller
    id. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("q"))
        .where(F.col("id").isNotNull() & finite & F.exists(F.col("vector"), lambda x: x != 0))
        .groupBy("id").agg(F.min("vector").alias("vector"), F.max("q").alias("q"))
        .withColumn("length", F.size("vector"))
    )
    sizes = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = None
    for width, n in sorted(sizes.items()):
        part = _nearest_of_width(rows.where(F.col("length") == width), n, width, k, factor, shard_rows)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vp_search(spark, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others; see README for the measured recall at this factor."""
    return nearest(C.table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), factor=3.0)
