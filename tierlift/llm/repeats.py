"""Remove repeated passages of at least ``window`` bytes, keeping the first occurrence.

A byte goes if a string of ``window`` bytes that covers it also starts earlier in the corpus:
in a document with a smaller id, or earlier in the same one. The longest previous factor at such
a start has at least ``window`` bytes, but no factor lengths are computed here and no suffixes
are put in order: only whether a window occurred before decides, so equal windows are grouped by
hash and compared, and in a group all but the one with the smallest position are repeats.

To let groups form in many tasks at once, windows meet where their text has an anchor. Anchors
are the places whose next ``ANCHOR`` bytes have the smallest hash among all that fit into some
window around them. A window contains at least one, and equal windows have theirs at the same
offset, so it is enough to compare windows around equal anchors.

1. Tasks find the anchors of their slice and a hash of each anchor's context, the bytes of all
   windows through it. Of anchors with equal contexts in a slice only the first is passed on;
   windows through the others are repeats. Anchors are packed by hash range, some thousand in
   a row.
2. Per hash range: among anchors with equal contexts all but the first are repeats. Anchors
   whose bytes also occur in another context are the borders of repeats; their first
   occurrences go on. They are a small share.
3. The contexts of borders are read from the text, and windows are grouped by anchor and
   offset, as said above, with a comparison of the bytes themselves (in the order of a hash,
   which decides nothing). If an anchor has more than ``limit`` contexts, its windows meet by their own hash instead, of which again only the
   first per slice is passed on, so no task holds such an anchor.
4. The repeats, packed by document, are joined with the text.

Hashes that stand for texts in steps 1 and 2 have 128 bits.

Defined cases: a null text is an empty one; texts under ``window`` bytes never change; a null
id comes before all others; rows that share an id follow each other in the order of a hash of
their text; identical rows count as one after another, so all but one go; an empty table gives
an empty one. Only id and text are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlift.llm.common import stored, text_slices, whole_text, with_key

ANCHOR = 32
SLICE_BYTES = 2 << 20
LIMIT = 2000
# An anchor with this many contexts in one slice is spread over the hash ranges.
SPREAD = 100
# Bytes of text per hash range and per group of documents.
RANGE_BYTES = 4 << 20
LEAST_RANGES = 256

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all substrings of ``ANCHOR`` bytes (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    width = 1
    while width < ANCHOR:
        h = h[:-width] * _B + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return _mix(h)


def _row_hash(rows: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of byte rows whose length is a multiple of eight."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), salt, dtype=np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * _A
        h ^= h >> np.uint64(32)
    return _mix(h)


def context_rows(data: np.ndarray, places: np.ndarray, local: np.ndarray, sizes: np.ndarray,
                 window: int) -> np.ndarray:
    """The bytes of all windows through anchors at ``places`` of ``data``.

    ``local`` are their positions in their own texts, ``sizes`` the bytes of these. Bytes of
    other texts are 0. ``data`` has a margin of 2 * ``window`` bytes at either end.
    """
    before, width = window - ANCHOR, 2 * window - ANCHOR
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[places - before]
    edge = np.flatnonzero((local < before) | (local + window > sizes))
    inside = local[edge, None] - before + np.arange(width)
    rows[edge] *= (inside >= 0) & (inside < sizes[edge, None])
    return rows


def _extents(positions: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(positions, window - ANCHOR), np.minimum(n - positions, window)


def _joined_texts(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a margin on either end, and where each begins."""
    margin = bytes(2 * window)
    data = np.frombuffer(b"".join([margin, *texts, margin]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    return data, 2 * window + np.cumsum(sizes) - sizes


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:len(x) - step], x[step:])
        done += step
    return x


ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("key", "<i8"), ("pos", "<i4"),
                  ("left", "u1"), ("right", "u1")])
SPAN = np.dtype([("key", "<i8"), ("start", "<i4"), ("end", "<i4")])
BORDER = np.dtype([("key", "<i8"), ("h", "<u8"), ("pos", "<i4"), ("hot", "u1")])
PACKED = "kind int, bucket int, data binary"
# Kinds of packed rows.
SPANS, BORDERS, ENTRIES, CONTEXTS, WINDOWS = range(5)


def _pack(kind: int, buckets: np.ndarray, records: np.ndarray) -> Iterator[dict]:
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(buckets)]):
        if b > a:
            yield {"kind": kind, "bucket": int(buckets[a]), "data": records[a:b].tobytes()}


def _rows(found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, schema=pa.schema(
        [("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())]))


def _unpack(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    data = [d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist())
            if k == kind]
    return np.frombuffer(b"".join(data), dtype=dtype)


# Keys are mixed before they are dealt, as ids may come in steps; a product of two such numbers
# stays below 2**63 on both sides.
_PRIME, _FACTOR = (1 << 31) - 1, 48_271


def _by_key(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The group of a document; the same as ``_group_column``."""
    return (keys % _PRIME * _FACTOR % _PRIME % ranges).astype(np.int32)


def _group_column(ranges: int):
    mixed = F.pmod(F.pmod("key", F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME))
    return F.pmod(mixed, F.lit(ranges)).cast("int")


def _by_hash(h: np.ndarray, ranges: int) -> np.ndarray:
    return (_mix(h) % np.uint64(ranges)).astype(np.int32)


def _repeat_runs(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """True for each sorted item that begins a run of equal columns."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        v = c[order]
        new[1:] |= v[1:] != v[:-1]
    return new


def slice_anchors(texts: list[bytes], keys: np.ndarray, window: int) -> np.ndarray:
    """The anchors of some texts as ``ENTRY`` records, by text and position."""
    long = [i for i, t in enumerate(texts) if len(t) >= window]
    if not long:
        return np.empty(0, dtype=ENTRY)
    data, begin = _joined_texts([texts[i] for i in long], window)
    sizes = np.array([len(texts[i]) for i in long])
    fit = window - ANCHOR + 1
    grams = _grams(data)
    low = _slide(grams, fit, np.minimum)
    # Windows that no text holds choose nothing.
    whole = np.zeros(len(low), dtype=bool)
    for at, n in zip(begin.tolist(), sizes.tolist()):
        whole[at:at + n - window + 1] = True
    low[~whole] = 0
    pad = np.zeros(fit - 1, dtype=np.uint64)
    chosen = np.flatnonzero((_slide(np.concatenate([pad, low, pad]), fit, np.maximum) >= grams)
                            & (grams > 0))
    text = np.searchsorted(begin, chosen, side="right") - 1
    local, size = chosen - begin[text], sizes[text]
    rec = np.empty(len(chosen), dtype=ENTRY)
    rec["h"], rec["key"], rec["pos"] = grams[chosen], keys[long][text], local
    rec["left"], rec["right"] = _extents(local, size, window)
    extent = rec["left"].astype(np.uint64) << np.uint64(8) | rec["right"]
    rec["c"] = _mix(_row_hash(context_rows(data, chosen, local, size, window), 3) ^ extent * _B)
    return rec


def _spans(entries: np.ndarray, window: int) -> np.ndarray:
    """What the windows through some anchors cover."""
    left, right = entries["left"].astype(np.int32), entries["right"].astype(np.int32)
    entries = entries[left + right >= window]
    out = np.empty(len(entries), dtype=SPAN)
    out["key"] = entries["key"]
    out["start"] = entries["pos"] - entries["left"]
    out["end"] = entries["pos"] + entries["right"]
    return out


def _joined(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["key"]))]
    out, begin = [], 0
    cuts = [*(np.flatnonzero(np.diff(spans["key"])) + 1), len(spans)]
    for cut in cuts:
        s, e = spans["start"][begin:cut], np.maximum.accumulate(spans["end"][begin:cut])
        new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
        part = np.empty(len(new), dtype=SPAN)
        part["key"] = spans["key"][begin]
        part["start"] = s[new]
        part["end"] = e[np.append(new[1:], len(e)) - 1]
        out.append(part)
        begin = cut
    return np.concatenate(out)


def _firsts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of hash, context and position; where a context begins."""
    order = np.lexsort((entries["pos"], entries["key"], entries["c"], entries["h"]))
    return entries[order], _repeat_runs(order, entries["h"], entries["c"])


def _contexts(window: int) -> np.dtype:
    return np.dtype([("h", "<u8"), ("key", "<i8"), ("pos", "<i4"), ("left", "u1"),
                     ("right", "u1"), ("text", "u1", (2 * window - ANCHOR,))])


def _anchor_step(window: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            entries = slice_anchors(texts, batch.column("key").to_numpy(), window)
            if not len(entries):
                continue
            entries, first = _firsts(entries)
            spans = _joined(_spans(entries[~first], window))
            entries = entries[first]
            home = _by_hash(entries["h"], ranges)
            # Anchors with many contexts here: one stays, the others are spread.
            anchor = np.cumsum(np.concatenate(
                [[True], entries["h"][1:] != entries["h"][:-1]])) - 1
            many = np.bincount(anchor)[anchor] >= SPREAD
            many[np.flatnonzero(np.diff(anchor, prepend=-1))] = False
            # Marks; extents stay below 128: spread, and stayed while others were spread.
            wide = np.bincount(anchor)[anchor] >= SPREAD
            entries["left"][wide & ~many] |= 0x80
            entries["right"][many] |= 0x80
            home[many] = _by_hash(entries["h"][many] ^ entries["c"][many], ranges)
            rows = [*_pack(SPANS, _by_key(spans["key"], ranges), spans),
                    *_pack(ENTRIES, home, entries)]
            yield from _rows(rows).to_batches()
    return run


def _match_step(window: int, ranges: int, limit: int):
    """Equal contexts of one hash range; rows for the documents they are in."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == SPANS:
            return table
        entries = _unpack(table, ENTRIES, ENTRY).copy()
        spread, stayed = entries["right"] >= 0x80, entries["left"] >= 0x80
        entries["right"] &= 0x7F
        entries["left"] &= 0x7F
        order = np.lexsort((entries["pos"], entries["key"], entries["c"], entries["h"]))
        entries, spread, stayed = entries[order], spread[order], stayed[order]
        every = np.arange(len(entries))
        first = _repeat_runs(every, entries["h"], entries["c"])
        anchor = np.cumsum(_repeat_runs(every, entries["h"])) - 1
        hot = np.bincount(anchor, weights=spread | stayed)[anchor] > 0
        spans = _joined(_spans(entries[~first], window))
        entries, hot, anchor = entries[first], hot[first], anchor[first]
        contexts = np.bincount(anchor)[anchor]
        border = (contexts > 1) | hot
        kept = entries[border]
        out = np.empty(len(kept), dtype=BORDER)
        for name in ("key", "h", "pos"):
            out[name] = kept[name]
        out["hot"] = (hot | (contexts > limit))[border]
        return _rows([*_pack(SPANS, _by_key(spans["key"], ranges), spans),
                      *_pack(BORDERS, _by_key(out["key"], ranges), out)])
    return run


def _context_step(window: int, ranges: int):
    """Contexts of the borders in one group of documents; windows instead where there are many."""
    dtype = _contexts(window)

    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        borders = _unpack(packed, BORDERS, BORDER)
        if not len(borders) or not docs.num_rows:
            return _rows([])
        borders = borders[np.lexsort((borders["pos"], borders["key"]))]
        row_of = {k: i for i, k in enumerate(docs.column("key").to_pylist())}
        texts = docs.column("text")
        keys, text = np.unique(borders["key"], return_inverse=True)
        joined = [texts[row_of[k]].as_py().encode() for k in keys.tolist()]
        data, begin = _joined_texts(joined, window)
        size = np.array([len(t) for t in joined])
        hot = borders["hot"] > 0
        windows, first = _firsts(_window_entries(
            data, begin, size, keys, text[hot], borders["pos"][hot], window))
        borders, text = borders[~hot], text[~hot]
        contexts = np.empty(len(borders), dtype=dtype)
        for name in ("h", "key", "pos"):
            contexts[name] = borders[name]
        local, sizes = borders["pos"], size[text]
        contexts["left"], contexts["right"] = _extents(local, sizes, window)
        contexts["text"] = context_rows(data, begin[text] + local, local, sizes, window)
        spans = _joined(_spans(windows[~first], window))
        windows = windows[first]
        return _rows([*_pack(CONTEXTS, _by_hash(contexts["h"], ranges), contexts),
                      *_pack(WINDOWS, _by_hash(windows["h"], ranges), windows),
                      *_pack(SPANS, _by_key(spans["key"], ranges), spans)])
    return run


def _window_entries(data: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray,
                    text: np.ndarray, local: np.ndarray, window: int) -> np.ndarray:
    """Every window through some anchors as an entry of its own, each once."""
    starts = local[:, None] - np.arange(window - ANCHOR + 1)
    text = np.broadcast_to(text[:, None], starts.shape)
    fits = (starts >= 0) & (starts + window <= size[text])
    place = np.unique((begin[text] + starts)[fits])
    rows = np.zeros((len(place), window + -window % 8), dtype=np.uint8)
    rows[:, :window] = np.lib.stride_tricks.sliding_window_view(data, window)[place]
    text = np.searchsorted(begin, place, side="right") - 1
    out = np.empty(len(place), dtype=ENTRY)
    out["h"], out["c"] = _row_hash(rows, 11), _row_hash(rows, 12)
    out["key"], out["pos"] = keys[text], place - begin[text]
    out["left"], out["right"] = 0, window
    return out


def previous_in_run(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For suffixes in truncated suffix order: the previous one with a smaller position.

    Runs of equal truncated suffixes are ordered by position, so it is the neighbour before,
    unless the suffix begins its run (-1): then neither the previous nor the next suffix with a
    smaller position agrees in the whole window.
    """
    before = np.full(len(order), -1)
    before[1:] = order[:-1]
    before[new] = -1
    out = np.empty(len(order), dtype=np.int64)
    out[order] = before
    return out


def _border_spans(rec: np.ndarray, window: int) -> np.ndarray:
    """Windows of border contexts that have an earlier equal one."""
    before = window - ANCHOR
    rec = rec[np.lexsort((rec["pos"], rec["key"], rec["h"]))]
    anchor = (np.cumsum(_repeat_runs(np.arange(len(rec)), rec["h"]))).astype(np.uint64)
    text = rec["text"]
    # Polynomial hashes of all prefixes; those of windows follow by subtraction.
    prefix = np.zeros((text.shape[1] + 1, len(rec)), dtype=np.uint64)
    for j in range(text.shape[1]):
        prefix[j + 1] = prefix[j] * _A + text[:, j] + np.uint64(1)
    power = np.uint64(pow(int(_A), window, 1 << 64))
    found = []
    for o in range(before + 1):
        at = np.flatnonzero((rec["left"] >= o) & (rec["right"] >= window - o))
        if len(at) < 2:
            continue
        low = before - o
        h = prefix[low + window, at] - prefix[low, at] * power
        order = np.lexsort((h, anchor[at]))  # stable: positions ascend within a run
        earlier = previous_in_run(order, _repeat_runs(order, anchor[at], h))
        repeat = np.flatnonzero(earlier >= 0)
        mine, other = at[repeat], at[earlier[repeat]]
        same = (text[mine, low:low + window] == text[other, low:low + window]).all(axis=1)
        if not same.all():
            raise RuntimeError("two windows share a hash")
        out = np.empty(len(mine), dtype=SPAN)
        out["key"], out["start"] = rec["key"][mine], rec["pos"][mine] - o
        out["end"] = out["start"] + window
        found.append(out)
    return _joined(np.concatenate(found)) if found else np.empty(0, dtype=SPAN)


def _border_step(window: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == SPANS:
            return table
        if kind == CONTEXTS:
            spans = _border_spans(_unpack(table, CONTEXTS, _contexts(window)), window)
        else:
            entries, first = _firsts(_unpack(table, WINDOWS, ENTRY))
            spans = _joined(_spans(entries[~first], window))
        return _rows([*_pack(SPANS, _by_key(spans["key"], ranges), spans)])
    return run


def _removal_step(keep_text: bool):
    """Texts of one group of documents with their repeats."""
    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        spans = _joined(_unpack(packed, SPANS, SPAN))
        cuts = np.searchsorted(spans["key"], np.stack(
            [docs.column("key").to_numpy(), docs.column("key").to_numpy() + 1]))
        out = {"doc_id": docs.column("doc_id"), "n_bytes": [], "removed": [], "kept_sha256": []}
        if keep_text:
            out["kept"] = []
        for text, a, b in zip(docs.column("text").to_pylist(), *cuts):
            data, at, kept, gone = text.encode(), 0, [], []
            for s, e in zip(spans["start"][a:b].tolist(), spans["end"][a:b].tolist()):
                kept.append(data[at:s])
                gone.append((s, e))
                at = e
            kept.append(data[at:])
            rest = b"".join(kept)
            out["n_bytes"].append(len(data))
            out["removed"].append([{"start": s, "end": e} for s, e in gone])
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                out["kept"].append(rest)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = {"n_bytes": pa.int64(), "removed": spans_type, "kept_sha256": pa.string(),
                 "kept": pa.binary()}
        return pa.table({k: v if k == "doc_id" else pa.array(v, type=types[k])
                         for k, v in out.items()})
    return run


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(key, doc_id, text)`` with a distinct key in the order of the documents."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                       whole_text(text_column).alias("text"))
    return with_key(rows, "key", "doc_id", "text").select("key", "doc_id", "text")


def remove_repeats(docs: DataFrame, window: int = 100, id_column: str = "doc_id",
                   text_column: str = "text", keep_text: bool = False,
                   limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept_sha256)`` and, if asked for, ``kept`` of every row.

    ``removed`` has the maximal removed runs as byte positions (end exclusive); ``kept`` is what
    is left as bytes, for a run may end inside a character.
    """
    if not ANCHOR < window < 128:
        raise ValueError(f"windows have from {ANCHOR + 1} to 127 bytes")
    rows = _keyed(docs, id_column, text_column)
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-total // RANGE_BYTES))

    anchors = rows.select("key", "text").mapInArrow(_anchor_step(window, ranges), PACKED)
    matched = stored(anchors.groupBy("kind", "bucket").applyInArrow(
        _match_step(window, ranges, limit), PACKED))
    group = _group_column(ranges)
    dealt = rows.select("key", "doc_id", "text", group.alias("bucket"))
    contexts = dealt.groupBy("bucket").cogroup(
        matched.where(F.col("kind") == BORDERS).groupBy("bucket")).applyInArrow(
        _context_step(window, ranges), PACKED)
    bordered = contexts.groupBy("kind", "bucket").applyInArrow(
        _border_step(window, ranges), PACKED)
    spans = matched.where(F.col("kind") == SPANS).union(bordered)
    schema = ("doc_id bigint, n_bytes bigint, removed array<struct<start: int, end: int>>, "
              "kept_sha256 string" + (", kept binary" if keep_text else ""))
    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(
        _removal_step(keep_text), schema)
