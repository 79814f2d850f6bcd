"""Exact top-k search by inner product with a KD-tree in every shard.

A shard is a bounded batch of vectors. Its tree splits at the median of the widest dimension down to leaves of LEAF
vectors; every node has a tight bounding box. For a query, the box's bound is the largest inner product any point of the
box could have. Traversal takes nodes best bound first and ends when the best bound left is below the query's k-th best
score, which is carried from shard to shard of a task, and at the start comes from the block of queries itself.

Queries are handled in blocks of at most block_rows rows, so what is broadcast has a fixed bound at any table size.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import fresh_path

LEAF, SHARD, EXACT = 64, 8192, 2**53


def usable_vectors(df: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * component) as longs; rows with a null id, vector or component, or a non-finite one, go."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).alias("vec_id"), v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


class Tree:
    """Points in the order of the leaves; boxes lo, hi, slices and children of the nodes."""

    def __init__(self, points: np.ndarray):
        self.order, self.nodes, lo, hi = np.arange(len(points)), [], [], []

        def build(first: int, last: int) -> int:
            part = points[self.order[first:last]]
            at = len(self.nodes)
            lo.append(part.min(0))
            hi.append(part.max(0))
            self.nodes.append((first, last, -1, -1))
            if last - first > LEAF and (wide := (hi[at] - lo[at])).any():
                half = (last - first) // 2
                self.order[first:last] = self.order[first:last][np.argpartition(part[:, wide.argmax()], half)]
                self.nodes[at] = (first, last, build(first, first + half), build(first + half, last))
            return at

        build(0, len(points))
        self.lo, self.hi = np.array(lo), np.array(hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with each node's box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T


def _numbers(rows: list[np.ndarray]) -> np.ndarray:
    """Floats where every sum of products stays exact in them, else Python integers."""
    points = np.array(rows, np.int64).reshape(len(rows), -1)
    most = max((abs(int(points.max(initial=0))), abs(int(points.min(initial=0)))))
    return points.astype(np.float64) if most * most * max(1, points.shape[1]) * 2 < EXACT else points.astype(object)


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: list[list[tuple[int, int]]], floor: list, k: int) -> None:
    """Bring best (per query: a heap of (score, -id), k at most) up to date with the points of one tree."""
    bounds = tree.bounds(queries)
    for q in range(len(queries)):
        heap, vector, own = best[q], queries[q], query_ids[q]
        least = max(heap[0][0] if len(heap) == k else float("-inf"), floor[q])
        todo = [(-bounds[q, 0], 0)]
        while todo:
            bound, at = heapq.heappop(todo)
            if -bound < least:
                break
            first, last, left, right = tree.nodes[at]
            if left >= 0:
                for child in (left, right):
                    if bounds[q, child] >= least:
                        heapq.heappush(todo, (-bounds[q, child], child))
                continue
            index = tree.order[first:last]
            scores = points[index] @ vector
            for j in np.flatnonzero(scores >= least):
                entry, name = (int(scores[j]), -int(ids[index[j]])), int(ids[index[j]])
                if name == own:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    least = max(least, heap[0][0])


def _block(vectors: DataFrame, block: list, k: int) -> DataFrame:
    """The k best of all vectors for the queries of one block."""
    by_size: dict[int, tuple] = {}
    for size in {len(v) for _, v in block}:
        rows = [(n, v) for n, v in block if len(v) == size]
        names, points = np.array([n for n, _ in rows], np.int64), _numbers([v for _, v in rows])
        scores = points @ points.T
        others = [np.sort(scores[i][names != names[i]])[::-1] for i in range(len(rows))]
        by_size[size] = (names, points, [s[k - 1] if len(s) >= k else float("-inf") for s in others])
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        found = {size: [[] for _ in names] for size, (names, _, _) in shared.value.items()}
        for b in batches:
            for start in range(0, b.num_rows, SHARD):
                part = b.slice(start, SHARD)
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    if int(size) not in found:
                        continue
                    chosen = np.flatnonzero(sizes == size)
                    flat = lists.take(pa.array(chosen)).flatten().to_numpy(zero_copy_only=False).reshape(len(chosen), size)
                    names, queries, floor = shared.value[int(size)]
                    points = _numbers(list(flat))
                    if points.dtype == object or queries.dtype == object:
                        points, queries = flat.astype(object), queries.astype(object)
                        if queries.size and isinstance(queries.flat[0], float):
                            queries = np.vectorize(int, otypes=[object])(queries)
                    search(Tree(points), points, ids[chosen], queries, names, found[int(size)], floor, k)
        rows = [(int(q), -n, s) for size, heaps in found.items() for q, heap in zip(shared.value[size][0], heaps, strict=True) for s, n in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=schema)

    partial = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of df for every row that is_query holds for.

    Ties go to the smaller id. Rows that share the query's id are its own and never its neighbours; repeated query rows
    are answered once, repeated candidates count each. Vectors meet only vectors of their length. Rows with a null id or
    an unusable vector take no part; vectors may have any length. An empty table gives no rows. Ids are integers; other columns are ignored.
    """
    spark = df.sparkSession
    vectors = usable_vectors(df, scale, id_col, vector_col)
    rows = ((int(n), np.array(v, np.int64)) for n, v in usable_vectors(df.where(is_query), scale, id_col, vector_col).dropDuplicates(["vec_id"]).toLocalIterator())
    first, second = list(islice(rows, block_rows)), list(islice(rows, block_rows))
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not second:
        return _block(vectors, first, k)
    path = fresh_path(spark, "top-k")
    for block in (first, second):
        _block(vectors, block, k).write.mode("append").parquet(path)
    while block := list(islice(rows, block_rows)):
        _block(vectors, block, k).write.mode("append").parquet(path)
    return spark.read.parquet(path)
