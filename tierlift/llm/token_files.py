"""Token ids in flat binary files that can be memory-mapped.

Format of a folder: per part three files without headers, ``<part>.tokens`` (unsigned
little-endian integers, 2 bytes when every id fits, else 4), ``<part>.offsets`` (64-bit: where
each document starts inside its part, one more than documents) and ``<part>.docs`` (64-bit
document ids), and a Parquet table ``manifest`` with a row per part. Parts are in ascending
order of document id. The position of a part in the whole sequence, its base, is the prefix
sum of the token counts of the parts before it.

A task attempt writes files of its own name; only those of the attempt that Spark counted are
in the manifest, so a lost executor or a second attempt never shows in the data.

Defined cases: a null text is an empty one (its tokens: the end id alone), null document ids
come first, repeated rows are all written, an empty table gives no parts, columns other than
the two named ones are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlift.llm.common import text_slices, whole_text
from tierlift.llm.pieces import encode_texts

MANIFEST = "part int, file string, width int, docs bigint, null_docs bigint, tokens bigint"
# Pieces the library encodes in one call, as one text.
JOINED = 100


class LibraryEncoder:
    """The tokenizers library behind ``encode_texts``: distinct pieces are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A byte-level token has one character for each of its bytes.
        self.n_bytes = np.zeros(self.size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(token)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self._ids(texts)]

    def pieces(self, pieces: list[str]) -> pa.Array:
        # Each piece with a space in front may stand behind any other, so many make one text;
        # the others are encoded one by one.
        spaced = next((i for i, p in enumerate(pieces) if p[:1] != " "), len(pieces))
        coded = self._ids(["".join(pieces[i:min(i + JOINED, spaced)])
                           for i in range(0, spaced, JOINED)])
        ids = np.array(list(chain.from_iterable(coded)), dtype="<u4")
        wanted = np.cumsum(pc.binary_length(pa.array(pieces[:spaced], pa.string())).to_numpy())
        reached = np.cumsum(self.n_bytes[ids])
        at = np.searchsorted(reached, wanted) + 1
        if spaced and not (reached[np.minimum(at, len(ids)) - 1] == wanted).all():
            raise RuntimeError("a token crosses the end of a piece")
        alone = self._ids(pieces[spaced:])
        ends = len(ids) + np.cumsum([len(x) for x in alone], dtype=np.int64)
        offsets = np.concatenate([[0], at, ends]).astype(np.int32) * 4
        data = ids.tobytes() + np.array(list(chain.from_iterable(alone)), dtype="<u4").tobytes()
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(pieces), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One tokenizer per worker process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every text and write the files and the manifest below ``folder``.

    ``folder`` must be one that all executors reach. ``end_id`` is appended to each document.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                       whole_text(text_column).alias("text"))
    # The text takes part in the order, so one repeated id may be spread over many parts.
    ordered = rows.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    size = library_encoder(tokenizer_path).size
    top = max(size, 0 if end_id is None else end_id + 1)
    width = 2 if top <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        store, root = pafs.FileSystem.from_uri(folder)
        sinks: dict = {}
        docs_written = nulls = tokens = 0
        try:
            for batch in text_slices(batches):
                if not batch.num_rows:
                    continue
                if not sinks:
                    sinks = {k: store.open_output_stream(f"{root}/{name}.{k}")
                             for k in ("tokens", "offsets", "docs")}
                # Most different pieces of a slice are rare words, which no memo would hold.
                coded = encode_texts(batch.column("text"), encoder.pieces, encoder.whole,
                                     encoder.special, None)
                lengths = np.array([(len(c) + len(end)) // 4 for c in coded], dtype=np.int64)
                ids = np.frombuffer(b"".join(x for c in coded for x in (c, end)), dtype="<u4")
                starts = tokens + np.concatenate([[0], np.cumsum(lengths)[:-1]])
                sinks["tokens"].write(ids.astype(f"<u{width}").tobytes())
                sinks["offsets"].write(starts.astype("<i8").tobytes())
                keys = batch.column("doc_id")
                sinks["docs"].write(pc.fill_null(keys, 0).to_numpy().astype("<i8").tobytes())
                docs_written += batch.num_rows
                nulls += keys.null_count
                tokens += int(lengths.sum())
            if sinks:
                sinks["offsets"].write(np.array([tokens], dtype="<i8").tobytes())
        finally:
            for s in sinks.values():
                s.close()
        if docs_written:
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "width": width, "docs": docs_written,
                  "null_docs": nulls, "tokens": tokens}], schema=_manifest_schema())

    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).write.mode(
        "errorifexists").parquet(f"{folder}/manifest")


def _manifest_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("file", pa.string()), ("width", pa.int32()),
                      ("docs", pa.int64()), ("null_docs", pa.int64()), ("tokens", pa.int64())])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with each part's base. One row per part, so the window is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn(
        "base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint"))


def _open(store: pafs.FileSystem, path: str):
    """Memory-mapped where the file system is local, else read by ranges."""
    if isinstance(store, pafs.LocalFileSystem):
        return pa.memory_map(path)
    return store.open_input_file(path)


def _scan(folder: str, digest: bool, per_batch: int = 2048):
    """Read parts; per document its ids or only their checksum."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for m in batch.to_pylist():
                files = {k: _open(store, f"{root}/{m['file']}.{k}")
                         for k in ("tokens", "offsets", "docs")}
                for low in range(0, m["docs"], per_batch):
                    n = min(per_batch, m["docs"] - low)
                    starts = np.frombuffer(
                        files["offsets"].read_at((n + 1) * 8, low * 8), dtype="<i8")
                    keys = np.frombuffer(files["docs"].read_at(n * 8, low * 8), dtype="<i8")
                    data = files["tokens"].read_at(
                        int(starts[-1] - starts[0]) * m["width"], int(starts[0]) * m["width"])
                    ids = np.frombuffer(data, dtype=f"<u{m['width']}").astype("<u4")
                    local = starts - starts[0]
                    columns = {
                        "doc_id": pa.array(keys, mask=np.arange(low, low + n) < m["null_docs"]),
                        "start": pa.array(starts[:-1] + m["base"]),
                        "n_tokens": pa.array(np.diff(starts))}
                    if digest:
                        raw = memoryview(ids.tobytes())
                        columns["ids_crc32"] = pa.array(
                            [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(local, local[1:])],
                            type=pa.int64())
                    else:
                        columns["ids"] = pa.ListArray.from_arrays(
                            pa.array(local.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)
                for f in files.values():
                    f.close()
    return read


def _documents(spark: SparkSession, folder: str, digest: bool, schema: str) -> DataFrame:
    parts = read_manifest(spark, folder)
    # A part is the unit of work; they hold about as much each.
    return parts.repartition("file").mapInArrow(_scan(folder, digest), schema)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, from the files."""
    return _documents(spark, folder, False,
                      "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def document_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: the checksum is over 32-bit ids."""
    return _documents(spark, folder, True,
                      "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
