"""Nearest neighbours by a block matrix join with quantised products.

Queries and candidates are dealt into blocks of bounded bytes, and every block
of queries meets every block of candidates as one group of a join (a tile).
Inside a tile unit vectors are rounded to 8-bit integers; the products of their
blocks give every cosine up to a bound that follows from the lengths of the
rounding errors. Only pairs whose upper bound reaches the query's k-th best
lower bound are computed again in double precision, and each query keeps a heap
of its k best. The heaps of a query's tiles are merged by a ranking, which Spark
cuts to k rows in every task before its shuffle.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES = 4 << 20  # a block of queries, in doubles
BLOCK_BYTES = 32 << 20  # a block of candidates, in doubles
LEAST_BLOCKS = 32  # so that small tables use the whole cluster
QUERY_RUN, BLOCK_RUN = 512, 4_096  # rows multiplied at once inside a tile
EXACT_DIMS = 1_024  # so many products of 8-bit integers add up exactly in single precision
PAIRS_AT_ONCE = 1 << 18


class Quantised:
    """Unit vectors as 8-bit integers: rows[i] is near scale[i] * codes[i], error[i] is the length of the difference."""

    def __init__(self, vectors: np.ndarray):
        unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None])
        rest = unit - codes * self.scale[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest))
        self.codes = codes.astype(np.int8)

    def bounds(self, a: slice, other: Quantised, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the cosines of two runs of rows."""
        left, right = self.codes[a], other.codes[b]
        product = np.zeros((len(left), len(right)))
        for k in range(0, left.shape[1], EXACT_DIMS):
            product += left[:, k:k + EXACT_DIMS].astype(np.float32) @ right[:, k:k + EXACT_DIMS].astype(np.float32).T
        product *= self.scale[a, None]
        product *= other.scale[None, b]
        # u.w = (u' + r).(w' + s) with |u'| <= 1 + |r|; the last term covers rounding in doubles.
        r, s = self.error[a, None], other.error[None, b]
        bound = r + s + 3 * r * s + 1e-9
        return product - bound, product + bound


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows in double precision, summed from the first component to the last."""
    dot, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
        left += x * x
        right += y * y
    return dot / (np.sqrt(left) * np.sqrt(right))


def _vectors(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def tile(k: int, queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """Each query's k best of a block of candidates."""
    names = ["query_id", "query_key", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    if not queries.num_rows or not candidates.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
    q_ids, ids = queries.column("vec_id").to_numpy(), candidates.column("vec_id").to_numpy()
    q_vec, vec = _vectors(queries, "vector"), _vectors(candidates, "vector")
    q_codes, codes = Quantised(q_vec), Quantised(vec)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for i in range(0, len(q_ids), QUERY_RUN):
        a = slice(i, i + QUERY_RUN)
        for j in range(0, len(ids), BLOCK_RUN):
            b = slice(j, j + BLOCK_RUN)
            low, high = q_codes.bounds(a, codes, b)
            own = q_ids[a, None] == ids[None, b]
            low[own], high[own] = -np.inf, -np.inf
            reach = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[a]])
            if low.shape[1] >= k:
                reach = np.maximum(reach, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            rows, columns = np.nonzero((high >= reach[:, None]) & ~own)
            for at in range(0, len(rows), PAIRS_AT_ONCE):
                r, c = rows[at:at + PAIRS_AT_ONCE] + i, columns[at:at + PAIRS_AT_ONCE] + j
                for row, score, name in zip(r.tolist(), cosines(q_vec[r], vec[c]).tolist(), ids[c].tolist(), strict=True):
                    heap = heaps[row]
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -name))
                    elif (score, -name) > heap[0]:
                        heapq.heapreplace(heap, (score, -name))
    sizes = np.array([len(h) for h in heaps])
    keys = queries.column("query_key").to_numpy()
    pairs = [pair for heap in heaps for pair in heap]
    return pa.Table.from_arrays([
        pa.array(np.repeat(q_ids, sizes), kinds[0]), pa.array(np.repeat(keys, sizes), kinds[1]),
        pa.array([-name for _, name in pairs], kinds[2]), pa.array([score for score, _ in pairs], kinds[3]),
    ], names)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) and dim of rows that take part, equal rows once."""
    vector = F.col("embedding").cast("array<double>")
    most = 1.7976931348623157e308
    finite = F.forall("vector", lambda x: x.isNotNull() & x.between(-most, most))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0)
    ).distinct().withColumn("dim", F.size("vector"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, query_bytes: int = QUERY_BYTES, block_bytes: int = BLOCK_BYTES, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """The k rows with the largest cosine for each row whose vec_id is divisible by ``every``.

    vectors: vec_id and embedding (an array of numbers), other columns are
    ignored. Result: query_id, rank (from 1), vec_id, score; the nearest first,
    ties to the smaller vec_id, all candidates if there are fewer than k.

    Rows take no part whose vec_id or vector is null, or whose vector is empty,
    all zero or holds a null or non-finite component. Rows equal in id and
    vector count once; rows with the query's id are the query's own; a query id
    with several vectors has k rows for each. Vectors meet those of their own
    length only. Nothing is approximate: the bounds never lose a pair.

    Of candidates with one and the same vector, those with the k + 1 smallest ids
    can be among the nearest of anything, so only these meet the queries; a
    vector that very many rows share costs no more than any other.
    """
    rows = usable(vectors)
    queries = rows.where(F.col("vec_id") % every == 0)
    same = Window.partitionBy("vector").orderBy("vec_id")
    candidates = rows.withColumn("_place", F.row_number().over(same)).where(F.col("_place") <= k + 1).drop("_place")
    is_query = F.col("vec_id") % every == 0
    sizes = rows.agg(F.sum(F.col("dim") * 8).alias("all"), F.sum(F.when(is_query, F.col("dim") * 8)).alias("queries")).first()
    n_query = max(1, -(-(sizes["queries"] or 0) // query_bytes))
    n_block = max(least_blocks, -(-(sizes["all"] or 0) // block_bytes))
    key = F.xxhash64("vec_id", "vector")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "vector", "dim", key.alias("query_key"), F.pmod(key, F.lit(n_query)).cast("int").alias("q")).withColumn("b", every_of(n_block))
    right = candidates.select("vec_id", "vector", "dim", F.pmod(key, F.lit(n_block)).cast("int").alias("b")).withColumn("q", every_of(n_query))
    at = ("dim", "q", "b")
    tiles = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(partial(tile, k), "query_id long, query_key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
