"""Exact top-k search by no-random-access aggregation.

A block of candidates keeps one sorted list for each dimension. A query reads all
lists from their best end (descending where its component is positive, else
ascending), in growing steps. Of a candidate it knows the contributions read so
far; an unread one lies between the list's worst and the value just read. These
give every candidate a lower and an upper bound of its score. Reading stops when
few candidates have an upper bound that reaches the k-th best lower bound, or the
lists end; only those can qualify, and their scores are then resolved exactly.
The best k of every block are merged by score.

Queries and candidates meet in blocks of bounded size, so a task holds one block
of each, whatever the table's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, ship

CANDIDATES = 4096  # of a block
QUERIES = 256  # of a block
_FEW = 64


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), for vectors that take part.

    A null id, a null vector, or one with a null or non-finite component takes no part.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(math.inf)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<long>").alias("v"))


def nra(matrix: np.ndarray, queries: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """For each query, the rows that can be among its ``k`` best (k: one number for each query).

    All queries read the lists to the same depth, so that one matrix product gives what they have read: a list read from its
    top to depth t has shown the rows of the t last ranks, from its bottom those of the t first.
    """
    n = len(matrix)
    out = [np.arange(n)] * len(queries)
    if n <= _FEW:
        return out
    x = matrix.astype(np.float64)
    order = np.argsort(matrix, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    going = np.arange(len(queries))
    depth = max(1, n // 16)
    while len(going):
        depth = min(depth, n)
        up, down = np.maximum(queries[going], 0).astype(np.float64), np.minimum(queries[going], 0).astype(np.float64)
        top, bottom = rank >= n - depth, rank < depth
        # an unread contribution is no less than the list's worst, and no greater than the value just read
        low = (up @ lists[0] + down @ lists[-1])[:, None] + up @ ((x - lists[0]) * top).T + down @ ((x - lists[-1]) * bottom).T
        high = (up @ lists[n - depth] + down @ lists[depth - 1])[:, None] + up @ ((x - lists[n - depth]) * top).T + down @ ((x - lists[depth - 1]) * bottom).T
        still = []
        for i, q in enumerate(going.tolist()):
            m = min(int(k[q]), n)
            limit = np.partition(low[i], n - m)[n - m]
            able = np.flatnonzero(high[i] >= limit - 1e-9 * max(1.0, abs(limit)))
            if len(able) <= max(m, _FEW) or depth == n:
                out[q] = able
            else:
                still.append(q)
        going, depth = np.array(still, np.int64), depth * 2
    return out


def _search(k: int):
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        n, q = candidates.num_rows, queries.num_rows
        if not n or not q:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        ids, query_ids = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        matrix = candidates["v"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        wanted = queries["v"].combine_chunks().flatten().to_numpy().reshape(q, -1)
        # a query's own rows are no candidates: as many more may stand before its k-th
        own = np.array([np.count_nonzero(ids == i) for i in query_ids])
        out = []
        for query_id, query, able in zip(query_ids, wanted, nra(matrix, wanted, k + own), strict=True):
            able = able[ids[able] != query_id]
            score = matrix[able] @ query
            best = np.lexsort((ids[able], -score))[:k]
            out.append((np.full(len(best), query_id), ids[able][best], score[best]))
        return pa.table({c: pa.array(np.concatenate(x), t) for (c, t), x in zip(kinds.items(), zip(*out, strict=True), strict=True)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` candidates of greatest integer inner product for each query.

    ``vectors`` has vec_id, v (integers, as from integer_vectors); ``is_query`` is a condition on vec_id. Returns query_id, rank
    (from 1), vec_id, score; all candidates, if there are fewer. Ties go to the smaller vec_id. Candidates of a query are
    all rows of its length with another vec_id; a repeated row is a candidate each time. Of query rows with equal ids the least
    vector asks. Vectors without components score 0. Sums must fit a long. No query or no candidate: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = saved(vectors.select("vec_id", "v"), "topk-vectors")
    queries = saved(rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "topk-queries")
    n_blocks = max(1, -(-rows.count() // CANDIDATES))
    n_asked = max(1, -(-queries.count() // QUERIES))
    # the saved table's row numbers deal rows evenly, equal ids too
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))).withColumn("dim", F.size("v"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_asked))).withColumn("dim", F.size("v"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    keys = ["dim", "block", "part"]
    found = dealt.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "query_id", "v").groupBy(*keys))
    found = found.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
