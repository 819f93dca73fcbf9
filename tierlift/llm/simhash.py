"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link when at most ``radius`` bits differ. Each bit position gets a
vector of radius + 1 bits; each of the 2^(radius + 1) - 1 vectors that are not zero gives one
mask, the positions whose vector has an odd product with it. A set of at most ``radius``
positions always leaves a vector that has an even product with all of theirs, so for every
pair within the radius some mask covers none of the bits in which the two differ: they share
that table's bucket for certain.

Documents with one fingerprint are one node. Buckets are compared by ``bucket_links``, which
returns for each member the smallest one it is connected to, not all pairs.

Defined cases: a null text is an empty one; a text without words has fingerprint 0 and links
like any other; rows without an id get the group of their fingerprint, and the group is null
if none of its members has an id; repeated rows each get their row; an empty table gives an
empty one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlift.llm.buckets import bucket_links, hamming_near, local_components
from tierlift.llm.common import drop_stored, fresh_name, stored, text_slices, whole_text
from tierlift.llm.components import connected_components

BITS = 64
HASH_SEED = 42
SLICE_BYTES = 4 << 20

# The bits of each byte value, one per byte of a word: adding words adds eight counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_SPREAD = np.ascontiguousarray(_SPREAD).view("<u8").ravel()


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For groups of ``counts`` hashes each (all above 0): bits set in over half of them."""
    ends = np.cumsum(counts)
    starts = ends - counts
    # Counters of one byte hold up to 255, so groups are added up in pieces of that many.
    pieces = -(-counts // 255)
    first = np.cumsum(pieces) - pieces
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + 255 * inner
    out = np.zeros(len(counts), dtype=np.uint64)
    for b in range(8):
        lanes = _SPREAD[((hashes >> np.uint64(8 * b)) & np.uint64(255)).astype(np.intp)]
        part = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(part, first, axis=0)
        bits = (2 * total > counts[:, None]).astype(np.uint8)
        byte = np.packbits(bits, axis=1, bitorder="little").ravel().astype(np.uint64)
        out |= byte << np.uint64(8 * b)
    return out


def text_fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts: A-Z lowered, words cut at ASCII white space."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        parts = text.lower().split()
        if not parts:
            continue
        line = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(digest(line, HASH_SEED))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        starts = np.concatenate([[0], ends[:-words]])
        hashes += [digest(line[a:b], HASH_SEED)
                   for a, b in zip(starts.tolist(), (ends[words - 1:] - 1).tolist())]
        counts[k] = len(starts)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = counts > 0
    if full.any():
        out[full] = majority_bits(np.array(hashes, dtype=np.uint64), counts[full])
    return out


def fingerprints(docs: DataFrame, words: int, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``(doc_id, digest, fingerprint)`` of every row; the fingerprint's bits are in a bigint.

    ``digest`` is a hash of the text, which tells rows with one id apart.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                       whole_text(text_column).alias("text"),
                       F.xxhash64(whole_text(text_column)).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = text_fingerprints(texts, words).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"),
                 "fingerprint": pa.array(found)})

    return rows.mapInArrow(run, "doc_id bigint, digest bigint, fingerprint bigint")


def covering_masks(radius: int, seed: int = 5) -> list[int]:
    """Signed 64-bit masks, one per table."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1, 1 << (radius + 1)) for _ in range(BITS)]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints within ``radius`` bits of each other.

    ``nodes`` has distinct ``fingerprint`` values. A pair within the radius is either a link
    or connected by links.
    """
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("masked"))
        for t, m in enumerate(covering_masks(radius))])
    rows = nodes.select("fingerprint", F.explode(tables).alias("x")).select(
        F.col("x.t").alias("t"), F.col("x.masked").alias("masked"), "fingerprint")

    def compare(rows: pa.Table, first: int | None) -> pa.Table | None:
        prints = rows.column("fingerprint").to_numpy()
        if len(prints) == 2:
            bits = prints.view(np.uint64)
            if np.bitwise_count(bits[0] ^ bits[1]) > radius:
                return None
            return pa.table({"a": prints[1:], "b": prints[:1]})
        near = hamming_near(prints.view(np.uint64)[:, None], radius, first)
        label = local_components(near)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": prints[moved], "b": prints[label[moved]]})

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return bucket_links(rows, ["t", "masked"], compare, schema, "fingerprint")


def near_groups(docs: DataFrame, words: int, radius: int, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """``(doc_id, digest, fingerprint, component_id)`` of every row.

    The component is the smallest id that links reach, the row's own included.
    """
    return _groups(docs, words, radius, id_column, text_column).drop("root")


def _groups(docs: DataFrame, words: int, radius: int, id_column: str,
            text_column: str) -> DataFrame:
    prints = stored(fingerprints(docs, words, id_column, text_column))
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    parts = connected_components(near_links(nodes, radius))
    members = stored(parts.join(nodes, F.col("node") == F.col("fingerprint")).select(
        "node", F.col("component").alias("root"), "least"))
    roots = stored(members.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = members.join(roots, "root").select("node", "root", "component_id")
    labels = stored(nodes.join(linked, F.col("node") == F.col("fingerprint"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"),
        F.coalesce("component_id", "least").alias("component_id")))
    drop_stored(nodes, members, roots)
    return prints.join(labels, "fingerprint").select(
        "doc_id", "digest", "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 4, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """One document of each group, with all of its columns.

    It is the one with the smallest id; rows without an id come last; of rows that share the
    id the one with the smallest text digest stays, and of rows alike in both the one with the
    smallest hash of all columns.
    """
    return keep_first(docs, _groups(docs, words, radius, id_column, text_column), id_column,
                      text_column)


def keep_first(docs: DataFrame, groups: DataFrame, id_column: str,
               text_column: str) -> DataFrame:
    """The document of each ``root`` of ``groups`` that ``keep_one`` keeps."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")
    best = stored(groups.groupBy("root").agg(F.min(order).alias("best")))
    kept, digest, row, rank = (fresh_name(docs, x) for x in ("kept", "digest", "row", "rank"))
    wanted = best.select(F.col("best.doc_id").alias(kept), F.col("best.digest").alias(digest))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.struct(*names).alias(row), F.xxhash64(*names).alias(rank),
        F.col(f"`{id_column}`").cast("bigint").alias(kept),
        F.xxhash64(whole_text(f"`{text_column}`")).alias(digest))
    # A null id is joined by a stand-in, marked by a second key.
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", F.col(kept).isNull().alias("_no_id")).fillna(0, [kept])

    left = keyed(rows).join(keyed(wanted), [kept, "_no_id", digest], "left_semi")
    one = left.groupBy(kept, "_no_id", digest).agg(F.min_by(row, rank).alias(row))
    return one.select(f"{row}.*")
