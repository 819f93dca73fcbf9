"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A text of at most ``CHUNK`` code points is counted where it is read: the places proven stable
below part it into words, and each different word is encoded once. A longer one is cut into chunks,
each of which reaches ``OVERLAP`` code points into the next, and the chunks are dealt over the
cluster. The encodings of two neighbours are spliced at the first common boundary of their
overlap: both have a token that starts right behind a white space there. Such a place is
proven stable. The pre-tokeniser drops white space, so no token and no special string reaches
across; the normaliser works character by character there (nothing composes with a white
space on its left or moves across it). So tokens before it depend on the text before it alone
and tokens behind it on the text behind it alone, whatever the wrong ends of the chunks are.

Where neighbours share no such place (a text without white space, say), the document is done
again with wider overlaps and chunks, until they meet or one chunk is the whole document.

A tokenizer whose normaliser, pre-tokeniser or special tokens are others than the proof
covers gets every text whole.

Defined cases: a null text is an empty one (no bytes, no tokens); repeated rows and rows of one
id are each counted; an empty table gives an empty one; all columns of the input stay, and
outputs replace columns of the same name, whatever their case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlift.llm.common import fresh_name, stored, text_slices, whole_text

CHUNK = 32_768
OVERLAP = 256
WIDEN = 8
# An encoding takes some hundred bytes a token, so few chunks are encoded at once.
SLICE_BYTES = 1 << 20
WORD_SLICE_BYTES = 4 << 20
# Words a worker remembers, about 130 bytes each.
KNOWN = 400_000
SPACES = " \t\n\r"
# Fixed value: a pattern that matches no white space, under which the proof holds.
PROVEN_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _steps(spec: dict | None, inner: str) -> list[dict]:
    if spec is None:
        return []
    return spec[inner] if spec["type"] == "Sequence" else [spec]


def splices_at_spaces(spec: dict) -> bool:
    """Whether the proof above covers the tokenizer with this specification."""
    for step in _steps(spec["normalizer"], "normalizers"):
        spaces = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"}
        if not (step["type"] in ("NFC", "Lowercase") or spaces and step["content"] == " "):
            return False
    first, *rest = _steps(spec["pre_tokenizer"], "pretokenizers") or [{"type": None}]
    if not (first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
            and first["pattern"].get("Regex") in PROVEN_PATTERNS):
        return False
    if any(s["type"] != "ByteLevel" or s["add_prefix_space"] or s["use_regex"] for s in rest):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
                   or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.at_spaces = splices_at_spaces(json.load(f))
        self.known: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: pa.Array) -> pa.Array:
        """Tokens of each text; parted at ASCII white space where that is proven stable."""
        if not self.at_spaces:
            return pa.array(self._whole(texts.to_pylist()), type=pa.int64())
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.known.get, words))
        missing = [i for i, n in enumerate(found) if n is None]
        if len(self.known) + len(missing) > KNOWN:
            self.known.clear()
        for i, n in zip(missing, self._whole([words[i] for i in missing])):
            found[i] = self.known[words[i]] = n
        tokens = np.array(found, dtype=np.int64)[coded.indices.to_numpy()]
        bounds = parts.offsets.to_numpy()
        total = np.append(0, np.cumsum(tokens))[bounds - bounds[0]]
        return pa.array(np.diff(total))

    def splices(self, chunks: list[str], borders: list[int]
                ) -> list[tuple[tuple[int, int], tuple[int, int], int]]:
        """Per chunk: first splice behind its start, first one behind ``border``, all tokens.

        A splice is (place in the chunk, tokens before it), with place -1 if there is none.
        """
        return [(_splice(text, e.offsets, 0), _splice(text, e.offsets, border), len(e))
                for text, border, e in zip(chunks, borders, self.tokenizer.encode_batch(
                    chunks, add_special_tokens=False))]


def _splice(text: str, offsets: list[tuple[int, int]], border: int) -> tuple[int, int]:
    low, high = 0, len(offsets)
    while low < high:
        middle = (low + high) // 2
        if offsets[middle][0] > border:
            high = middle
        else:
            low = middle + 1
    for i in range(low, len(offsets)):
        start = offsets[i][0]
        if text[start - 1] in SPACES and (i == 0 or offsets[i - 1][1] < start):
            return start, i
    return -1, 0


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One tokenizer per worker process."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``(key, part, last, body)`` of every text, dealt over the cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                text = text.as_py()
                starts = range(0, len(text), chunk)
                for group in (starts[i:i + 16] for i in range(0, len(starts), 16)):
                    yield pa.RecordBatch.from_pydict({
                        "key": [key] * len(group),
                        "part": pa.array([s // chunk for s in group], type=pa.int64()),
                        "last": [s + chunk >= len(text) for s in group],
                        "body": [text[s:s + chunk + overlap] if s + chunk < len(text)
                                 else text[s:] for s in group]})

    return (texts.mapInArrow(run, "key string, part bigint, last boolean, body string")
            .repartition("key", "part"))


def _sides(chunks: DataFrame, path: str, chunk: int) -> DataFrame:
    """``(key, border, side, place, tokens)``: what each chunk says of its two borders.

    Border ``i`` lies before part ``i``; its left side adds the tokens up to the splice, its
    right side takes those before the splice off. The end of the text is border -1.
    """
    schema = "key string, border bigint, side string, place bigint, tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = counter(path)
        for batch in text_slices(batches, "body", SLICE_BYTES):
            rows = []
            bodies = batch.column("body").to_pylist()
            found = library.splices(bodies, [chunk] * len(bodies))
            for key, part, last, (head, tail, total) in zip(
                    batch.column("key").to_pylist(), batch.column("part").to_pylist(),
                    batch.column("last").to_pylist(), found):
                if part:
                    rows.append((key, part, "right", head[0], -head[1]))
                if last:
                    rows.append((key, -1, "end", 0, total))
                else:
                    place = tail[0] - chunk if tail[0] >= 0 else -1
                    rows.append((key, part + 1, "left", place, tail[1]))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(columns[0], type=pa.string()),
                "border": pa.array(columns[1], type=pa.int64()),
                "side": pa.array(columns[2], type=pa.string()),
                "place": pa.array(columns[3], type=pa.int64()),
                "tokens": pa.array(columns[4], type=pa.int64())})

    return chunks.mapInArrow(run, schema)


def spliced_counts(texts: DataFrame, path: str, chunk: int = CHUNK,
                   overlap: int = OVERLAP) -> DataFrame:
    """``(key, n_tokens)`` of distinct ``(key, text)`` with texts longer than a chunk.

    Rows of one key must hold one text; they are counted once. Each round stores one row per
    border and side, so a lost executor costs at most a round.
    """
    done, todo = None, texts.select("key", "text")
    while True:
        sides = stored(_sides(_chunks(todo, chunk, overlap), path, chunk))
        borders = (
            sides.groupBy("key", "border", "side")
            .agg(F.min("place").alias("place"), F.min("tokens").alias("tokens"))
            .groupBy("key", "border")
            .agg(F.sum("tokens").alias("tokens"),
                 ((F.col("border") < 0) | (F.min("place") >= 0)
                  & (F.min("place") == F.max("place"))).alias("met")))
        documents = stored(borders.groupBy("key").agg(
            F.sum("tokens").alias("n_tokens"), F.bool_and("met").alias("met")))
        found = documents.where("met").select("key", "n_tokens")
        done = found if done is None else done.unionByName(found)
        missed = documents.where("not met").select("key")
        if missed.isEmpty():
            return done
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)
        todo = texts.select("key", "text").join(missed, "key", "left_semi")


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048,
                 text_column: str = "text", keep_text: bool = True, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Texts up to a chunk are encoded where they are read; only chunks of longer ones and one
    row per long document are shuffled.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        splices = splices_at_spaces(json.load(f))
    outputs = ["n_bytes", "n_tokens", "over_limit"]
    gone = set(outputs) | (set() if keep_text else {text_column.lower()})
    keep = [c for c in docs.columns if c.lower() not in gone]
    # Columns travel as one struct, so their names and types do not matter here.
    base = docs.select(F.struct(F.lit(0).alias(fresh_name(docs, "row")),
                                *[F.col(f"`{c}`") for c in keep]).alias("row"),
                       whole_text(f"`{text_column}`").alias("text"))
    n_bytes = F.octet_length("text").cast("bigint").alias("n_bytes")
    schema = T.StructType([base.schema["row"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = counter(tokenizer_path)
        for batch in text_slices(batches, limit=WORD_SLICE_BYTES):
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "n_bytes": batch.column("n_bytes"),
                "n_tokens": library.counts(batch.column("text"))})

    long = F.length("text") > chunk
    short = base if not splices else base.where(~long)
    out = short.select("row", n_bytes, "text").mapInArrow(run, schema)
    if splices:
        keyed = base.where(long).select("row", n_bytes, F.sha2("text", 256).alias("key"), "text")
        counts = spliced_counts(keyed, tokenizer_path, chunk, overlap)
        out = out.unionByName(
            keyed.join(counts, "key").select("row", "n_bytes", "n_tokens"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
