"""A quality classifier by co-training on two views of a document.

One classifier sees the text (shares of character classes, word lengths, repetition, hashed
words), the other only the metadata (language, source, length). Both start from labelled
documents. In each round every document is scored by both, and each hands the documents it is
surest of to the other as pseudo-labels. Then each view is calibrated on labelled documents it
was not trained on, the two calibrated scores are combined by a third small model, and all
documents are scored. A document is kept if its score reaches the threshold: one half, or less
if that is needed to keep the share ``keep_good`` of the good held-out documents.

What is bounded, and named so: the classifiers are fitted on at most ``LABELLED`` labelled
documents (the first by a hash of the id) and ``PER_ROUND`` pseudo-labels per class, view and
round, on the driver. Features, scores and the search for pseudo-labels cover all documents.

Defined cases: a null text is an empty one; null metadata count as an empty string or as a
missing length; labels that are null or belong to no document are ignored, of several labels
for one id the smallest counts; if either class has no label, every document gets score 1 and
is kept; repeated rows each get their row; an empty table gives an empty one; outputs replace
columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlift.llm.common import drop_stored, fresh_name, stored, text_slices, whole_text

LABELLED = 20_000
PER_ROUND = 2_000
ROUNDS = 3
SURE = 0.97
KEEP_GOOD = 0.998
SLICE_BYTES = 4 << 20
WORD_BUCKETS, LANGUAGE_BUCKETS, SOURCE_BUCKETS = 64, 16, 32
OUTPUTS = ["text_score", "meta_score", "quality_score", "kept"]

# Byte classes: letters small and large, digits, blank, line end, the commonest marks, others.
_CLASS = np.full(256, 15, dtype=np.int64)
_CLASS[128:] = 14
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                             b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"'\"", b"-:;()",
                             b"$%&*#@", b"|/\\_~^", b"<>{}[]=+"]):
    _CLASS[list(_chars)] = _k


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of features per text (none null)."""
    n = len(texts)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    flat = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    doc = np.repeat(np.arange(n), size)
    chars = np.bincount(doc * 16 + _CLASS[flat], minlength=n * 16).reshape(n, 16)
    chars = chars / np.maximum(size, 1)[:, None]

    words = pc.utf8_split_whitespace(texts)
    count = words.value_lengths().to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code, names = coded.indices.to_numpy(), coded.dictionary
    doc = np.repeat(np.arange(n), count)
    length = pc.utf8_length(names).to_numpy()[code]
    many = np.maximum(count, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=mask, minlength=n) / many

    mean = np.bincount(doc, weights=length, minlength=n) / many
    square = np.bincount(doc, weights=length.astype(float) ** 2, minlength=n) / many
    pair = doc * max(1, len(names)) + code
    distinct, times = np.unique(pair, return_counts=True)
    of = distinct // max(1, len(names))
    different = np.bincount(of, minlength=n) / many
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    after_next = np.zeros(len(code), dtype=bool)
    after_next[2:] = (code[2:] == code[:-2]) & (doc[2:] == doc[:-2])
    folded = [zlib.crc32(w.lower()) for w in names.cast(pa.binary()).to_pylist()]
    bucket = (np.array(folded, dtype=np.int64) % WORD_BUCKETS)[code]
    bag = np.bincount(doc * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS)
    bag = np.sqrt(bag.reshape(n, WORD_BUCKETS) / many[:, None])
    columns = [mean, np.sqrt(np.maximum(square - mean ** 2, 0)), share(length == 1),
               share(length <= 3), share(length > 12), different, most / many, share(again),
               share(after_next), different * np.log1p(count), np.log1p(count) / 10]
    return np.column_stack([chars, *columns, bag]).astype(np.float32)


def meta_features(language: list, source: list, length: list) -> np.ndarray:
    n = len(language)
    out = np.zeros((n, LANGUAGE_BUCKETS + SOURCE_BUCKETS + 4), dtype=np.float32)
    for i, (a, b, c) in enumerate(zip(language, source, length)):
        out[i, zlib.crc32((a or "").encode()) % LANGUAGE_BUCKETS] = 1
        out[i, LANGUAGE_BUCKETS + zlib.crc32((b or "").encode()) % SOURCE_BUCKETS] = 1
        size = np.log1p(max(0, c or 0))
        out[i, -4:] = c is None, size / 10, (size / 10) ** 2, size > 9
    return out


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Linear:
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (y - p) - penalty * w
            curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return np.clip(z @ self.weight[:-1] + self.weight[-1], -30, 30)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


@dataclass
class Model:
    text: Linear
    meta: Linear
    text_scale: Linear
    meta_scale: Linear
    combined: Linear
    threshold: float

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of either view."""
        return (self.text_scale.score(self.text.score(text)[:, None]),
                self.meta_scale.score(self.meta.score(meta)[:, None]))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = self.views(text, meta)
        return _chance(a), _chance(b), _chance(self.combined.score(np.column_stack([a, b])))


FEATURES = "doc_id bigint, pick bigint, text array<float>, meta array<float>"


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def _inputs(docs: DataFrame, text: str) -> list:
    return [whole_text(f"`{text}`").alias("text"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
            F.col("n_chars").cast("bigint").alias("n_chars")]


def _features(batch: pa.RecordBatch | pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    get = batch.column if isinstance(batch, pa.RecordBatch) else batch.field
    return text_features(get("text")), meta_features(
        *[get(c).to_pylist() for c in ("lang", "source", "n_chars")])


def features(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Both views of every document; ``pick`` is a hash that orders samples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE_BYTES):
            if batch.num_rows:
                a, b = _features(batch)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "pick": batch.column("pick"),
                    "text": _lists(a), "meta": _lists(b)})

    ids = F.col(f"`{id_column}`").cast("bigint")
    rows = docs.select(ids.alias("doc_id"), F.xxhash64(ids, F.lit(3)).alias("pick"),
                       *_inputs(docs, text))
    return rows.mapInArrow(run, FEATURES)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _surest(views: DataFrame, text: Linear, meta: Linear, per_round: int) -> pa.Table:
    """Pseudo-labels: per view and class the first sure documents without a label, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pick = batch.column("pick").to_numpy()
            for view, model in (("text", text), ("meta", meta)):
                p = _chance(model.score(_matrix(batch.column(view))))
                for good in (0, 1):
                    at = np.flatnonzero(p >= SURE if good else p <= 1 - SURE)
                    at = at[np.argsort(pick[at], kind="stable")[:per_round]]
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_pydict({
                        "view": pa.array([view] * len(at), pa.string()),
                        "good": pa.array([good] * len(at), pa.int32()),
                        "doc_id": rows.column("doc_id"), "pick": rows.column("pick"),
                        "text": rows.column("text"), "meta": rows.column("meta")})

    sure = stored(views.where("label is null").drop("label").mapInArrow(
        run, "view string, good int, " + FEATURES))
    parts = [sure.where((F.col("view") == v) & (F.col("good") == g)).orderBy(
        "pick", "doc_id").limit(per_round).toArrow() for v in ("text", "meta") for g in (0, 1)]
    drop_stored(sure)
    return pa.concat_tables(parts)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED,
          per_round: int = PER_ROUND, rounds: int = ROUNDS, keep_good: float = KEEP_GOOD,
          id_column: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on ``labels`` (``doc_id``, ``quality`` of 0 or 1); None if a class has no label."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("label"))
    views = stored(features(docs, id_column, text).join(marks, "doc_id", "left"))
    known = views.where("label is not null").orderBy("pick", "doc_id").limit(labelled).toArrow()
    y = known.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        drop_stored(views)
        return None
    a, b = _matrix(known.column("text")), _matrix(known.column("meta"))
    # Every fourth document of each class is held out.
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[1::4]] = True
    fit = ~held
    if len(np.unique(y[held])) < 2:
        held[:] = fit[:] = True  # too few labels to hold any out
    extra = {v: (np.empty((0, x.shape[1]), np.float32), np.empty(0)) for v, x in
             (("text", a), ("meta", b))}

    def fitted() -> tuple[Linear, Linear]:
        return tuple(Linear.fit(np.concatenate([x[fit], extra[v][0]]),
                                np.concatenate([y[fit], extra[v][1]]))
                     for v, x in (("text", a), ("meta", b)))

    text_model, meta_model = fitted()
    for _ in range(rounds):
        sure = _surest(views, text_model, meta_model, per_round)
        from_view = np.array(sure.column("view").to_pylist(), dtype=object)
        good = sure.column("good").to_numpy()
        # Each view learns from what the other is sure of.
        for learner, teacher in (("text", "meta"), ("meta", "text")):
            at = np.flatnonzero(from_view == teacher)
            if len(at):
                rows = sure.take(pa.array(at))
                extra[learner] = (_matrix(rows.column(learner)), good[at].astype(float))
        text_model, meta_model = fitted()
    drop_stored(views)
    scales = [Linear.fit(m.score(x[held])[:, None], y[held])
              for m, x in ((text_model, a), (meta_model, b))]
    model = Model(text_model, meta_model, *scales, combined=scales[0], threshold=0.5)
    model.combined = Linear.fit(np.column_stack(model.views(a[held], b[held])), y[held])
    scored = model.scores(a[held], b[held])[2]
    model.threshold = float(min(0.5, np.quantile(scored[y[held] == 1], 1 - keep_good)))
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``text_score``, ``meta_score``, ``quality_score`` and ``kept`` to the documents."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    if model is None:
        one = F.lit(1.0)
        return docs.select(*[F.col(f"`{c}`") for c in keep], *[
            one.alias(c) for c in OUTPUTS[:3]], F.lit(True).alias("kept"))
    row, seen = fresh_name(docs, "row"), fresh_name(docs, "seen")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(row),
                       F.struct(*_inputs(docs, text)).alias(seen),
                       F.octet_length(whole_text(f"`{text}`")).alias("size"))
    kinds = [T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([base.schema[row]] + [
        T.StructField(n, k) for n, k in zip(OUTPUTS, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(batch.column("size").to_numpy().astype(np.int64))
            cuts = np.flatnonzero(np.diff(total // SLICE_BYTES)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(int(low), int(high - low))
                if not part.num_rows:
                    continue
                fields = part.column(seen)
                names = [f.name for f in fields.type]
                found = model.scores(*_features(pa.RecordBatch.from_arrays(
                    fields.flatten(), names=names)))
                yield pa.RecordBatch.from_pydict({
                    row: part.column(row), **dict(zip(OUTPUTS, map(pa.array, found))),
                    "kept": pa.array(found[2] >= model.threshold)})

    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(f"{row}.`{c}`").alias(c) for c in keep], *OUTPUTS)
