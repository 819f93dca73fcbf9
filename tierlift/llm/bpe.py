"""Byte-level BPE by a traversal of the prefixes that words share.

The encoding of a word's prefix is settled by its last token alone: it is the one token that
ends the prefix and agrees with the last token of what lies before it. So the distinct words
of a slice of text are put in order, which is the depth-first order of their trie; walking
it, the last tokens along the path to the current node are kept, and a word adds only the
nodes below the prefix it shares with the word before. Following last tokens backwards from
the end of a word gives its ids.

Two tokens agree if BPE on their joined bytes gives these two again. A merge across the border
can only join a token on the right edge of the first one's merge tree with one on the left
edge of the second one's, before either is merged further on its own side.

Defined cases: a null text is an empty one, without ids; repeated rows are each encoded; an
empty table gives an empty one; all columns of the input stay, and outputs replace columns of
the same name.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlift.llm.common import fresh_name, text_slices, whole_text
from tierlift.llm.pieces import encode_texts

# The pre-tokeniser's pattern of byte-level BPE vocabularies.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Text that is encoded at once; its different words and their ids take many times as much.
SLICE_BYTES = 2 << 20
# Pairs of tokens a worker remembers between slices, about 100 bytes each.
AGREED = 500_000


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes follow from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_characters()
        model = spec["model"]
        vocab = model["vocab"]
        as_bytes = {t: bytes(byte_of[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = as_bytes[t]
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        # merge[left << 32 | right] = rank; left, right and rank: how a token is merged, or -1.
        self.merge: dict[int, int] = {}
        self.left, self.right, self.rank = (array("i", [-1]) * size for _ in range(3))
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("a merge uses a token that a later merge makes")
            self.merge[a << 32 | b] = rank
            if self.rank[c] < 0:
                self.left[c], self.right[c], self.rank[c] = a, b, rank
        self.byte_token = [vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.agreed: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        # Only tokens that BPE makes of their own bytes can occur in an encoding.
        left, right, rank = self.left, self.right, self.rank
        stable: dict[bytes, int] = {}
        known = bytearray(size)
        for i in sorted(vocab.values(), key=rank.__getitem__):
            known[i] = rank[i] < 0 or bool(known[left[i]] and known[right[i]] and self.agree(
                left[i], right[i], below=rank[i]))
            if known[i]:
                stable[self.token_bytes[i]] = i
        self.token_of = stable
        self.longest = max(map(len, stable))
        self.lengths = [len(t) for t in self.token_bytes]
        self.table = pa.array(self.token_bytes, type=pa.binary())

    def agree(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether BPE leaves the border between two tokens (up to rank ``below``)."""
        merge, left, right, rank = self.merge, self.left, self.right, self.rank
        # Tokens on an edge of a merge tree, each with the rank of the merge that took it.
        edge, y, y_taken = [], b, 1 << 60
        while y >= 0:
            edge.append((y, y_taken))
            y, y_taken = left[y], rank[y]
        x, x_taken = a, below
        while x >= 0:
            for y, y_taken in edge:
                found = merge.get(x << 32 | y)
                # Of equal merges the left one comes first.
                if found is not None and found < below and found < x_taken and found <= y_taken:
                    return False
            x, x_taken = right[x], rank[x]
        return True

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of sorted distinct words."""
        token_of, longest, agreed, lengths = self.token_of, self.longest, self.agreed, self.lengths
        last = [-1]
        before = b""
        out = []
        for word in words:
            n = len(word)
            shared, top = 0, min(len(before), n)
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    token = token_of.get(word[start:end])
                    if token is None:
                        continue
                    if start == 0:
                        break
                    key = last[start] << 32 | token
                    ok = agreed.get(key)
                    if ok is None:
                        ok = agreed[key] = self.agree(last[start], token)
                    if ok:
                        break
                else:
                    raise RuntimeError(f"no token ends {word[:end]!r}")
                last.append(token)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= lengths[last[at]]
            ids.reverse()
            out.append(ids)
            before = word
        if len(agreed) > AGREED:
            agreed.clear()
        return out

    def forget(self) -> None:
        """Empty the memos: a worker goes on with other work after this."""
        self.agreed.clear()
        self.known.clear()

    def pieces(self, pieces: list[str]) -> pa.Array:
        split = [WORDS.findall(p) for p in pieces]
        distinct = sorted({w.encode() for ws in split for w in ws})
        ids = {w: np.array(i, dtype="<u4").tobytes()
               for w, i in zip(distinct, self.words(distinct))}
        return pa.array([b"".join([ids[w.encode()] for w in ws]) for ws in split],
                        type=pa.binary())

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which special tokens may occur."""
        if self.special:
            finder = regex.compile("(" + "|".join(
                regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        out = []
        for text in texts:
            parts = finder.split(text) if self.special else [text]
            coded = iter(self.pieces([p for p in parts if p not in self.special]).to_pylist())
            out.append(b"".join(
                np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special
                else next(coded) for p in parts))
        return out

    def encode(self, texts: pa.Array) -> list[memoryview | bytes]:
        return encode_texts(texts, self.pieces, self.whole, list(self.special), self.known)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded text; what is no UTF-8 becomes the replacement sign."""
        raw = self.table.take(pa.array(ids)).buffers()[2]
        raw = raw.to_pybytes() if raw is not None and len(ids) else b""
        return raw.decode("utf-8", "replace").encode()


_encoders: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer_path: str, text_column: str = "text",
           ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit integers) and, if named, the decoded text.

    No shuffle: every task encodes the texts it reads, in slices of bounded size.
    """
    gone = {ids, decoded} | (set() if keep_text else {text_column})
    keep = [c for c in docs.columns if c not in gone]
    work = fresh_name(docs, "whole_text")
    # Columns travel as one struct, so their names and types do not matter here.
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                       whole_text(f"`{text_column}`").alias(work))
    schema = T.StructType([base.schema["row"], T.StructField(ids, T.BinaryType())]
                          + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(tokenizer_path)
        try:
            for batch in text_slices(batches, work, SLICE_BYTES):
                coded = encoder.encode(batch.column(work))
                columns = {"row": batch.column("row"),
                           ids: pa.array([bytes(c) for c in coded], type=pa.binary())}
                if decoded:
                    columns[decoded] = pa.array(
                        [encoder.decode(np.frombuffer(c, dtype="<u4")) for c in coded],
                        type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        finally:
            encoder.forget()
            pa.default_memory_pool().release_unused()

    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep],
                      *[c for c in (ids, decoded) if c])
