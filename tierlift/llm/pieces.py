"""Cut texts where a byte-level BPE never merges, so equal pieces are encoded once.

The pre-tokeniser pattern of GPT-style vocabularies takes at most one space into a word and
leaves the last space of a run to the word after it. A cut in front of a space that a
non-blank follows therefore never changes the token ids. Cutting at every space is the same
thing unless a space is followed by white space or ends the text; texts with such a space
take a slower way and are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space of the pre-tokeniser's pattern.
BLANKS = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = f" (?:[{BLANKS}]|$)"


# Pieces a worker remembers, about 200 bytes each.
KNOWN = 300_000


def _piece_ids(pieces: list[str], encode_pieces: Callable[[list[str]], pa.Array],
               known: dict[str, bytes]) -> pa.Array:
    found = list(map(known.get, pieces))
    missing = [i for i, ids in enumerate(found) if ids is None]
    wanted = [pieces[i] for i in missing]
    if len(known) + len(wanted) > KNOWN:
        known.clear()
    for i, piece, ids in zip(missing, wanted, encode_pieces(wanted).to_pylist()):
        found[i] = known[piece] = ids
    return pa.array(found, type=pa.binary())


def encode_texts(
    texts: pa.Array,
    encode_pieces: Callable[[list[str]], pa.Array],
    encode_whole: Callable[[list[str]], list[bytes]],
    special: list[str],
    known: dict[str, bytes] | None,
) -> list[memoryview | bytes]:
    """Token ids of every text as little-endian bytes.

    ``encode_pieces`` gives one binary value per piece, ``encode_whole`` one per text. Texts
    that hold a ``special`` string go to the latter: the tokenizer looks for it first.
    ``known`` keeps pieces from call to call; it is emptied when it has grown to ``KNOWN``. Where
    it is None every call encodes its own pieces.
    """
    texts = pc.fill_null(texts, "")
    whole = pc.match_substring_regex(texts, _UNSAFE)
    for s in special:
        whole = pc.or_(whole, pc.match_substring(texts, s))
    whole = np.asarray(whole.to_numpy(zero_copy_only=False), dtype=bool)
    out: list = [b""] * len(texts)

    rest = np.flatnonzero(whole)
    for i, ids in zip(rest, encode_whole(texts.take(pa.array(rest)).to_pylist())):
        out[i] = ids

    rest = np.flatnonzero(~whole)
    if len(rest):
        parts = pc.split_pattern(texts.take(pa.array(rest)), " ")
        bounds = parts.offsets.to_numpy()
        bounds = bounds - bounds[0]
        # The first part of a text has no space in front of it, all others have one.
        coded = parts.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        names, codes = coded.dictionary, coded.indices.to_numpy().copy()
        first = bounds[:-1]
        heads, head_codes = np.unique(codes[first], return_inverse=True)
        pieces = [" " + s for s in names.to_pylist()] + names.take(pa.array(heads)).to_pylist()
        codes[first] = len(names) + head_codes
        found = encode_pieces(pieces) if known is None else _piece_ids(pieces, encode_pieces, known)
        ids = found.take(pa.array(codes))
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[: len(ids) + 1]
        data = memoryview(ids.buffers()[2] or b"")
        for i, a, b in zip(rest, ends[bounds[:-1]], ends[bounds[1:]]):
            out[i] = data[a:b]
    return out
