"""Embedding near-duplicates with an inverted multi-index.

Each vector, scaled to length 1, is cut into halves with a codebook of their own. A cell of
the index is a pair of centroids, and every vector is in the cell of its nearest pair. A vector
visits cells in the order of the summed distances of its halves, the multi-sequence order; how
many is found on a sample: as many as give the target recall there, for pairs of the sample and
for pairs made by moving sampled vectors until their cosine is just the threshold. All vectors
in visited cells are compared in double precision.

A pair counts if either vector visits the other's cell; if both do, only in the smaller cell,
so it counts once. Equal vectors are one node with a weight, so groups of copies cost nothing.
Large cells are cut into blocks (``bucket_links``).

The codebooks and the number of visits come from at most ``SAMPLE`` vectors; every vector is
indexed and every vector is a query.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components have
no links and are their own component; a null id gives the component of its vector's group; rows
that repeat an id or a vector count as rows of their own; vectors of another length than the
longest count as filled up with zeros; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlift.llm.buckets import bucket_links, local_components
from tierlift.llm.common import drop_stored, stored
from tierlift.llm.components import connected_components
from tierlift.llm.vectors import finite, matrix

SAMPLE = 20_000
PER_CELL = 64
TARGET = 0.995
ROUNDS = 12


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = ((rows * rows).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)
         - 2 * rows @ centroids.T)
    return np.maximum(d, 0)


def fit_codebook(rows: np.ndarray, size: int, seed: int) -> np.ndarray:
    """k-means; a centroid that loses all rows takes the row that is farthest from its own."""
    draw = np.random.default_rng(seed)
    centroids = rows[draw.permutation(len(rows))[:size]].copy()
    for _ in range(ROUNDS):
        d = _distances(rows, centroids)
        near = d.argmin(axis=1)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, rows)
        full = count > 0
        centroids[full] = total[full] / count[full, None]
        if not full.all():
            far = np.argsort(-d[np.arange(len(rows)), near])[:(~full).sum()]
            centroids[~full] = rows[far]
    return centroids


class MultiIndex:
    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.half = books[0].shape[1]
        self.visits = 1

    def visited(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The first n cells of each row in multi-sequence order; the first is its own."""
        k0, k1 = len(self.books[0]), len(self.books[1])
        n = min(n, k0 * k1)
        d0 = _distances(rows[:, :self.half], self.books[0])
        d1 = _distances(rows[:, self.half:], self.books[1])
        o0, o1 = np.argsort(d0, axis=1, kind="stable"), np.argsort(d1, axis=1, kind="stable")
        s0, s1 = np.take_along_axis(d0, o0, 1), np.take_along_axis(d1, o1, 1)
        # The pair of the i-th and the j-th nearest comes after (i + 1)(j + 1) - 1 others.
        pairs = [(i, j) for i in range(min(n, k0)) for j in range(min(n // (i + 1), k1))]
        i, j = np.array(pairs).T
        pick = np.argsort(s0[:, i] + s1[:, j], axis=1, kind="stable")[:, :n]
        return (np.take_along_axis(o0, i[pick], 1).astype(np.int64) * k1
                + np.take_along_axis(o1, j[pick], 1))

    def calibrate(self, rows: np.ndarray, threshold: float, target: float, seed: int) -> None:
        """Set the number of visits from sampled pairs at or over the threshold."""
        draw = np.random.default_rng(seed)
        some = rows[draw.permutation(len(rows))[:500]]
        noise = draw.normal(size=some.shape)
        noise = unit(noise - (noise * some).sum(axis=1, keepdims=True) * some)
        left = [some]
        right = [threshold * some + np.sqrt(1 - threshold ** 2) * noise]
        cos = some @ rows.T
        a, b = np.nonzero((cos >= threshold) & (cos < 1 - 1e-9))
        pick = draw.permutation(len(a))[:5000]
        left.append(some[a[pick]])
        right.append(rows[b[pick]])
        n = 1
        while True:
            found = [((self.visited(x, n) == self.visited(y, 1)).any(axis=1)
                      | (self.visited(y, n) == self.visited(x, 1)).any(axis=1))
                     for x, y in zip(left, right) if len(x)]
            if all(f.mean() >= target for f in found) or n >= len(self.books[0]) ** 2:
                break
            n = n + max(1, n // 4)
        self.visits = n


def fit_index(sample: np.ndarray, n_vectors: int, threshold: float, target: float = TARGET,
              seed: int = 7) -> MultiIndex:
    """Codebooks with about ``PER_CELL`` vectors of the whole set per cell."""
    rows = unit(sample)
    half = max(1, rows.shape[1] // 2)
    size = min(max(1, round((n_vectors / PER_CELL) ** 0.5)), len(rows))
    index = MultiIndex((fit_codebook(rows[:, :half], size, seed),
                        fit_codebook(rows[:, half:], size, seed + 1)))
    index.calibrate(rows, threshold, target, seed + 2)
    return index


LINKS = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "links")])


def _compare(threshold: float):
    def compare(rows: pa.Table, first: int | None) -> pa.Table | None:
        member = rows.column("cell").to_numpy() == rows.column("own_cell").to_numpy()
        if not member.any():
            return None
        vectors = matrix(rows.column("vector"), np.float64)
        x = unit(vectors)
        n, cell = len(x), rows.column("cell").to_numpy()[0]
        cos = x @ x.T
        near = cos >= threshold
        for i, j in np.argwhere(np.abs(cos - threshold) < 1e-9):
            u, v = vectors[i], vectors[j]
            near[i, j] = (u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum())
                                          ) >= threshold
        near = near & near.T  # rounding must not make a link one-sided
        np.fill_diagonal(near, False)
        near &= member[:, None] | member[None, :]
        if first is not None:
            near[:first, :first] = False
            near[first:, first:] = False
        # A pair that meets in both cells counts in the smaller one.
        visits, own = rows.column("visits").to_pylist(), rows.column("own_cell").to_numpy()
        for m in np.flatnonzero(member & near.any(axis=1)):
            twice = near[m] & ~member & (own < cell) & np.isin(own, visits[m])
            near[m, twice] = near[twice, m] = False
        label = local_components(near)
        links = near @ rows.column("weight").to_numpy()
        some = np.flatnonzero(links)
        nodes = rows.column("node").to_numpy()
        return pa.table({"a": nodes[some], "b": nodes[label[some]], "links": links[some]})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id",
                    vector_column: str = "embedding", target: float = TARGET) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of the input."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"),
                          F.col(vector_column).alias("vector"))
    good = finite("vector") & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(good, F.lit(False))
    nodes = stored(rows.where(usable).groupBy("vector").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).select(
        F.monotonically_increasing_id().alias("node"), "vector", "least", "weight"))
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).select("vector").toArrow()
    alone = rows.where(~usable).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    width = nodes.agg(F.max(F.size("vector"))).first()[0]
    wide = matrix(sample.column("vector"), np.float64)
    index = fit_index(np.pad(wide, ((0, 0), (0, width - wide.shape[1]))), n, threshold, target)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"), np.float64)
                x = unit(np.pad(x, ((0, 0), (0, width - x.shape[1]))))
                cells = index.visited(x, index.visits)
                offsets = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
                yield batch.append_column("visits", pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(cells.ravel())))

    kind = nodes.schema["vector"].dataType
    schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("vector", kind),
        T.StructField("weight", T.LongType()), T.StructField("visits", T.ArrayType(T.LongType()))])
    placed = nodes.select("node", "vector", "weight").mapInArrow(place, schema)
    met = placed.select("node", "vector", "weight", "visits",
                        F.element_at("visits", 1).alias("own_cell"),
                        F.explode("visits").alias("cell"))
    links = stored(bucket_links(met, ["cell"], _compare(threshold), LINKS, "node", limit=1000))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select("a", "b"))
    members = stored(nodes.select("node", "least").join(
        parts, "node").select("node", "component", "least"))
    roots = stored(members.groupBy("component").agg(F.min("least").alias("root")))
    linked = members.join(roots, "component").select("node", "root")
    labels = stored(nodes.join(linked, "node", "left").join(
        counts, F.col("node") == F.col("a"), "left").select(
        "vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "least").alias("component_id")))
    drop_stored(members, roots, links)
    out = rows.where(usable).join(labels, "vector").select(
        "vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
