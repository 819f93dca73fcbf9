"""Exact top-k by inner product with no-random-access aggregation.

Each dimension of a block of candidates is a list sorted by component; a query reads it from
the end where its products are largest. After reading all lists to some depth, a candidate's
score lies between the sum of what was seen plus each unseen list's last product, and the same
sum plus each unseen list's next product. Candidates whose upper bound is under the k-th best
lower bound cannot qualify and are dropped; reading goes on until those left are few or read
completely, and their final scores are then added up. A bound that ties stays in, so ties are
decided by the smaller id at the end.

Candidates and queries are cut into blocks; every pair of blocks is one group of bounded size.
The best k of each block are merged per query. Queries are a stated share of the rows, so the
work is that of comparing them with all rows, in blocks, less what the bounds save.

Defined cases: rows whose id or vector is null, empty or not finite take no part; a shorter
vector counts as filled up with zeros; rows that repeat an id are candidates of their own, and
none with the query's own id is a candidate for it; query rows that share an id, alike or not, each
rank every candidate, and the k best of them all are the id's, as in the query's SQL; an empty table
gives an empty one. Scores must fit 53 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlift.llm.common import stored
from tierlift.llm.vectors import finite, matrix

CANDIDATES_PER_BLOCK = 16384
QUERIES_PER_BLOCK = 4096
# Depth of a reading step as a share of the lists, and how many candidates end the reading.
STEP = 8
FEW = 64
# Queries whose bounds are held at once, two numbers per candidate each.
AT_ONCE = 128


class Lists:
    """One block's lists: the sorted components of each dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows.astype(np.float64), ids
        self.sorted = np.sort(self.rows, axis=0)
        self.peak = float(np.abs(self.rows).max(initial=0))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query ``(score, id)`` of the k best rows without those that have its own id.

        All queries of a call read their lists to the same depth at a time. What a list's reader
        from the top knows of a component x is max(x, entry) as upper and, where x has not been
        read, the list's last entry as lower bound; from the bottom it is the other way round.
        These do not depend on the query, so its bounds are two products of matrices.
        """
        n, width = self.rows.shape
        q = queries[:, :width].astype(np.float64)
        # Sums of integers this small are exact in single precision.
        single = self.peak * float(np.abs(q).max(initial=0)) * width < 1 << 24
        kind = np.float32 if single else np.float64
        rows, lists = self.rows.astype(kind), self.sorted.astype(kind)
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        out: list = [None] * len(q)
        open_ = np.arange(len(q))
        depth = 0
        while len(open_):
            depth = min(n, depth + max(1, n // STEP))
            if n <= max(FEW, k) or depth == n:  # all is read
                for i in open_:
                    out[i] = self._resolved(np.arange(n), q[i], own[i], k)
                break
            top, bottom = lists[n - 1 - depth], lists[depth]
            high = up[open_] @ np.maximum(rows, top).T + down[open_] @ np.minimum(rows, bottom).T
            low = (up[open_] @ np.where(rows >= top, rows, lists[0]).T
                   + down[open_] @ np.where(rows <= bottom, rows, lists[-1]).T)
            left = []
            for i, upper, lower in zip(open_, high, low):
                mine = np.flatnonzero(self.ids == own[i])
                upper[mine] = lower[mine] = -np.inf
                bar = np.partition(lower, n - k)[n - k]
                alive = np.flatnonzero(upper >= bar)
                if len(alive) <= FEW:
                    out[i] = self._resolved(alive, q[i], own[i], k)
                else:
                    left.append(i)
            open_ = np.array(left, dtype=int)
        return out

    def _resolved(self, at: np.ndarray, query: np.ndarray, own: int,
                  k: int) -> list[tuple[int, int]]:
        at = at[self.ids[at] != own]
        scores = (self.rows[at] @ query).astype(np.int64)
        order = np.lexsort((self.ids[at], -scores))[:k]
        return [(int(scores[i]), int(self.ids[at[i]])) for i in order]


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows, ties to the smaller id.

    Vectors have integer components; ``is_query`` marks the rows that are queries as well.
    """
    rows = stored(vectors.where(F.col(id_column).isNotNull() & finite(vector_column)).select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query")))
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    n_blocks = max(1, -(-sizes[0] // CANDIDATES_PER_BLOCK))
    n_parts = max(1, -(-sizes[1] // QUERIES_PER_BLOCK))
    deal = F.xxhash64("vec_id", "vector")
    candidates = rows.select(
        "vec_id", "vector", F.pmod(deal, F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    queries = rows.where("is_query").select(
        F.col("vec_id"), "vector", F.pmod(deal, F.lit(n_parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            lists = Lists(matrix(left.column("vector"), np.int64),
                          left.column("vec_id").to_numpy())
            asked, own = matrix(right.column("vector"), np.int64), right.column("vec_id").to_numpy()
            for low in range(0, len(own), AT_ONCE):
                part = own[low:low + AT_ONCE]
                for o, best in zip(part.tolist(), lists.best(asked[low:low + AT_ONCE], part, k)):
                    found += [(o, i, s) for s, i in best]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({name: pa.array(c, type=pa.int64())
                         for name, c in zip(("query_id", "vec_id", "score"), columns)})

    best = candidates.groupBy("block", "part").cogroup(
        queries.groupBy("block", "part")).applyInArrow(
        search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, factor: int, vector_column: str = "embedding") -> DataFrame:
    """Components as floor(factor * x), in double precision."""
    return vectors.where(finite(vector_column)).withColumn(vector_column, F.transform(
        vector_column, lambda x: F.floor(x.cast("double") * F.lit(float(factor)))))
