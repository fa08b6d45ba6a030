"""Exact top-k by inner product with one KD-tree per shard.

Vectors are dealt to shards by a hash of id and row.  Each shard builds a
KD-tree: splits at the median of the widest dimension down to leaves, a tight
box around each node.  The inner product of a query with any point of a box is
at most ``sum(max(q*lo, q*hi))``.  A block of queries goes down the tree level
by level, leaving nodes whose bound is under the query's k-th score, then
visits leaves best first, raising the k-th score as it goes.

Queries first search the shard that holds them; the k-th score found there is
propagated to all other shards, which return only what can still enter.
Queries travel in blocks, and a shard returns at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._spark import materialize

#: Vectors of a shard at most; fewer where that keeps all cores busy.
SHARD_ROWS = 65_536
#: Queries of other shards that meet a shard in one task.
BLOCK_ROWS = 65_536
LEAF_ROWS = 128
NONE = np.iinfo(np.int64).min
RESULT = "query_id long, vec_id long, score long"


class Tree:
    """A KD-tree over integer vectors: points in leaf order, boxes by level."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, bounds = np.arange(len(ids)), [(0, len(ids))]
        levels = [bounds]
        while max(b - a for a, b in bounds) > leaf_rows:
            below = []
            for a, b in bounds:
                own = points[order[a:b]]
                wide = int(np.argmax(own.max(0) - own.min(0))) if b > a else 0
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid)] if b - a > 1 else order[a:b]
                below += [(a, a + mid), (a + mid, b)]
            bounds = below
            levels.append(bounds)
        self.ids, self.points = ids[order], points[order]
        self.levels = []
        for bounds in levels:
            boxes = [(self.points[a:b].min(0), self.points[a:b].max(0)) if b > a else (np.zeros(points.shape[1]), np.zeros(points.shape[1])) for a, b in bounds]
            self.levels.append((np.array([x[0] for x in boxes]), np.array([x[1] for x in boxes])))
        self.leaves = levels[-1]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query index, ids, scores) of up to k best for each query, among scores of at least ``kth``; ties to smaller ids."""
        n = len(queries)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        kth = kth.astype(np.float64)
        live = np.ones((n, 1), bool)
        bound = np.zeros((n, 1))
        for depth, (lo, hi) in enumerate(self.levels):
            if depth:
                live = np.repeat(live, 2, axis=1)
            bound = up @ hi.T + down @ lo.T
            live &= bound >= kth[:, None]
        bound[~live] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        best_s = np.full((n, 0), -np.inf)
        best_i = np.zeros((n, 0), np.int64)
        rows = np.arange(n)
        active = rows
        for step in range(len(self.leaves)):
            leaf = order[active, step]
            active = active[bound[active, leaf] >= np.maximum(kth[active], -np.finfo(float).max)]
            if not len(active):
                break
            leaf = order[active, step]
            got_q, got_i, got_s = [], [], []
            by = np.argsort(leaf, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                a, b = self.leaves[leaf[part[0]]]
                q = active[part]
                score = queries[q] @ self.points[a:b].T
                keep = (score >= kth[q][:, None]) & (self.ids[a:b][None, :] != query_ids[q][:, None])
                i, j = np.nonzero(keep)
                got_q.append(q[i]), got_i.append(self.ids[a:b][j]), got_s.append(score[i, j])
            new_q, new_i, new_s = map(np.concatenate, (got_q, got_i, got_s))
            if len(new_q):
                best_s, best_i, kth = _merge(best_s, best_i, kth, new_q, new_i, new_s, k)
        for q in rows:
            have = best_s[q] > -np.inf if best_s.shape[1] else np.zeros(0, bool)
            if have.any():
                yield q, best_i[q][have], best_s[q][have]


def _merge(best_s, best_i, kth, new_q, new_i, new_s, k):
    """Best k of what each query has and what is new to it."""
    width = best_s.shape[1]
    touched, slot = np.unique(new_q, return_inverse=True)
    old_q = np.repeat(np.arange(len(touched)), width)
    q = np.concatenate([old_q, slot])
    i = np.concatenate([best_i[touched].ravel(), new_i])
    s = np.concatenate([best_s[touched].ravel(), new_s])
    real = s > -np.inf
    q, i, s = q[real], i[real], s[real]
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    q, i, s, rank = (x[rank < k] for x in (q, i, s, rank))
    if width < k:
        best_s = np.pad(best_s, ((0, 0), (0, k - width)), constant_values=-np.inf)
        best_i = np.pad(best_i, ((0, 0), (0, k - width)))
    best_s[touched] = -np.inf
    best_s[touched[q], rank], best_i[touched[q], rank] = s, i
    full = best_s[touched, k - 1]
    kth = kth.copy()
    kth[touched] = np.maximum(kth[touched], full)
    return best_s, best_i, kth


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    rows = rows if isinstance(rows, pa.Array) else pa.concat_arrays(rows.chunks)
    size = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _search(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    if not points.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    p, q = _matrix(points.column("point")), _matrix(queries.column("v"))
    width = max(p.shape[1], q.shape[1])
    p, q = _width(p, width), _width(q, width)
    if np.abs(p).max(initial=0) * np.abs(q).max(initial=0) * max(width, 1) >= 2**53:
        raise OverflowError("scores beyond 2**53 are not exact in double arithmetic; scale the vectors down")
    tree = Tree(points.column("id").to_numpy(), p)
    ids = queries.column("vec_id").to_numpy()
    kth = queries.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
    kth[kth == float(NONE)] = -np.inf
    out_q, out_i, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(ids), 1024):
        for row, got, score in tree.search(ids[at : at + 1024], q[at : at + 1024], kth[at : at + 1024], k):
            out_q.append(np.full(len(got), ids[at + row])), out_i.append(got), out_s.append(score)
    return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s).astype(np.int64)})


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<double> of whole numbers): floor(scale * x), x as double; vectors that are null or hold null, NaN or infinite components are left out."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .filter(v.isNotNull() & F.col("vec_id").isNotNull())
        .filter(~bad)
        .withColumn("v", F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("double")))
    )


def kd_top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k best others by integer inner product, ties to the smaller id.

    ``vectors`` has vec_id and v, whole numbers as doubles (see
    :func:`quantized`); ``is_query`` tells its queries.  A shorter vector
    counts as filled up with zeros.  Fewer than k others: all of them.  Rows
    that repeat an id are candidates each, except for queries of that id.
    Scores beyond 2**53 raise OverflowError.  Other columns are not read.
    A task holds one shard of about ``shard_rows`` rows and one block of about
    ``block_rows`` queries; a shard's rows travel once for each block.
    """
    spark = vectors.sparkSession
    # rows of one id are dealt out too; the number of a row is written down, so that it is the same in each later read
    numbered = vectors.select("vec_id", "v", is_query.alias("q"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("deal"))
    rows = materialize(numbered, "vectors")
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_rows), min(2 * cores, n // 2048))
    rows = rows.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int"))
    queries = rows.filter("q").groupBy("vec_id", "v").agg(F.min("shard").alias("shard"))
    blocks = max(1, -(-rows.filter("q").count() // block_rows))

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        return _search(points, asked, k)

    points = rows.select(F.col("shard").alias("at"), F.col("vec_id").alias("id"), F.col("v").alias("point"))
    home = materialize(points.groupBy("at").cogroup(queries.withColumn("kth", F.lit(NONE)).groupBy("shard")).applyInArrow(run, RESULT), "home")
    kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NONE)).alias("kth"))
    away = (
        queries.withColumnRenamed("shard", "own")
        .join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        .withColumn("kth", F.coalesce("kth", F.lit(NONE)))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .filter("shard <> own")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
        .select("vec_id", "v", "shard", "block", "kth")
    )
    copies = points.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = home.unionByName(copies.groupBy("at", "to").cogroup(away.groupBy("shard", "block")).applyInArrow(run, RESULT)) if shards > 1 else home
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
