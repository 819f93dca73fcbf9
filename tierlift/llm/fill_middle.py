"""Fill-in-the-middle documents as piece tables.

A document is never edited. It becomes a list of descriptors ``(buffer, start, length)`` over
immutable buffers: the text is buffer 0, the sentinels are buffers 1 to 3. Two cuts split the
descriptor of the text into prefix, middle and suffix; sentinels and parts are then put into
the order of a form by a permutation. The inverse permutation over the descriptors of the
written document gives the text back. Hashes are fed descriptor by descriptor.

``arrange`` decides per document, from a hash of its id alone, so that a repeated run or a lost
task gives the same documents. Offsets and lengths count code points.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix,
prefix, middle), each part behind its sentinel.

Defined cases: a null text is an empty one, which is plain; so is a text that holds a sentinel,
since it could not be told from a written one. A null id hashes as an empty number. Rows of one
id are cut by the same four numbers, each for its own length. An empty table gives an empty one.
All columns of the input stay, in place; outputs replace columns of the same name, whatever
their case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tierlift.llm.common import fresh_name, text_slices, whole_text

Piece = tuple[int, int, int]
TEXT, PREFIX, SUFFIX, MIDDLE = range(4)
# The order in which each form writes its buffers and parts: (sentinel, part of the text).
ORDERS = {
    "psm": ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")),
    "spm": ((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle")),
}


@dataclass(frozen=True)
class Rule:
    """Sentinels, the percentage of documents rewritten, and that of these written as spm."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rewritten: int = 90
    spm: int = 20
    seed: int = 1

    def buffers(self, text: str) -> tuple[str, str, str, str]:
        return text, self.prefix, self.suffix, self.middle

    def in_text(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text

    def __post_init__(self):
        marks = self.buffers("")[1:]
        # A sentinel that begins another or is begun by its end could be found across a border.
        for a in marks:
            if not a:
                raise ValueError("an empty sentinel")
            for b in marks:
                overlap = any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a != b)))
                if overlap or a != b and a in b:
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """Cut the descriptors ``at`` code points after their start."""
    out, left = [], at
    for buffer, start, length in pieces:
        if 0 < left < length:
            out += [(buffer, start, left), (buffer, start + left, length - left)]
        else:
            out.append((buffer, start, length))
        left -= length
    return out


def parts(length: int, first: int, second: int) -> dict[str, list[Piece]]:
    """Prefix, middle and suffix of a text of ``length`` cut at two places."""
    pieces = split(split([(TEXT, 0, length)], second), first)
    return {
        "prefix": [p for p in pieces if p[1] < first],
        "middle": [p for p in pieces if first <= p[1] < second],
        "suffix": [p for p in pieces if p[1] >= second and p[2]],
    }


def permuted(form: str, cut: dict[str, list[Piece]], rule: Rule) -> list[Piece]:
    sizes = [len(b) for b in rule.buffers("")]
    return [p for mark, part in ORDERS[form] for p in [(mark, 0, sizes[mark]), *cut[part]]]


def written(pieces: list[Piece], buffers: tuple[str, ...]) -> Iterator[str]:
    for buffer, start, length in pieces:
        yield buffers[buffer][start:start + length]


def original(output: str, form: str, rule: Rule) -> list[Piece]:
    """Descriptors over a written document that give its text, in the order of the text.

    The sentinels are found left to right; the parts behind them are put back into the order
    prefix, middle, suffix. That is the inverse of what ``permuted`` did.
    """
    if form == "plain":
        return [(TEXT, 0, len(output))]
    marks, found, starts, at = rule.buffers(""), {}, [], 0
    for mark, _ in ORDERS[form]:
        here = output.index(marks[mark], at)
        starts.append((here, here + len(marks[mark])))
        at = here + len(marks[mark])
    ends = [here for here, _ in starts[1:]] + [len(output)]
    for (_, part), (_, start), end in zip(ORDERS[form], starts, ends):
        found[part] = (TEXT, start, end - start)
    return [found[part] for part in ("prefix", "middle", "suffix")]


def streamed_sha256(chunks: Iterable[str]) -> str:
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk.encode())
    return digest.hexdigest()


def _numbers(id_column: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()),
                             ("length", pa.int64())]))
ARRANGED = pa.schema([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
    ("middle_chars", pa.int64()), ("pieces", PIECES), ("output", pa.string()),
    ("output_sha256", pa.string())])
RESTORED = pa.schema([("restored", pa.string()), ("restored_sha256", pa.string())])


def _mapped(df: DataFrame, inputs: dict[str, Column], added: pa.Schema,
            rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Add the columns ``added``, one tuple of ``rows`` each; no shuffle, slices of bounded size."""
    taken = {name.lower() for name in added.names}
    keep = [c for c in df.columns if c.lower() not in taken]
    # Columns travel as one struct, so their names and types do not matter here.
    base = df.select(F.struct(F.lit(0).alias(fresh_name(df, "row")),
                              *[F.col(f"`{c}`") for c in keep]).alias("row"),
                     *[c.alias(name) for name, c in inputs.items()])
    names = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, names[0]):
            made = list(rows(*[batch.column(name).to_pylist() for name in names]))
            columns = zip(*made) if made else [[]] * len(added)
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column("row")}
                | {f.name: pa.array(c, type=f.type) for f, c in zip(added, columns)})

    schema = T.StructType([base.schema["row"], *from_arrow_schema(added).fields])
    return base.mapInArrow(run, schema).select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep], *added.names)


def arrange(docs: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """Cut and permute every document.

    Adds ``n`` (code points), ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain),
    the ``pieces`` of the written document, the written ``output`` and its ``output_sha256``
    (lower-case hex, UTF-8).
    """
    def rows(texts, h1, h2, h3, h4):
        for text, a, b, share, kind in zip(texts, h1, h2, h3, h4):
            n, buffers = len(text), rule.buffers(text)
            if not n or rule.in_text(text) or share % 100 >= rule.rewritten:
                form, sizes, pieces = "plain", (None, None), [(TEXT, 0, n)] if n else []
            else:
                form = "spm" if kind % 100 < rule.spm else "psm"
                first, second = sorted((a % (n + 1), b % (n + 1)))
                sizes = first, second - first
                pieces = permuted(form, parts(n, first, second), rule)
            chunks = list(written(pieces, buffers))
            yield (n, form, *sizes, [dict(zip(("buffer", "start", "length"), p)) for p in pieces],
                   "".join(chunks), streamed_sha256(chunks))

    inputs = {"text": whole_text(f"`{text_column}`")} | {
        f"h{i}": h for i, h in enumerate(_numbers(f"`{id_column}`", rule.seed), 1)}
    return _mapped(docs, inputs, ARRANGED, rows)


def restore(arranged: DataFrame, rule: Rule = Rule(), output_column: str = "output",
            form_column: str = "form") -> DataFrame:
    """Add ``restored`` and ``restored_sha256``: the text, from the written document and form.

    A null document is an empty one; a null form is plain.
    """
    def rows(outputs, forms):
        for output, form in zip(outputs, forms):
            chunks = list(written(original(output, form, rule), (output,)))
            yield "".join(chunks), streamed_sha256(chunks)

    inputs = {"output": whole_text(f"`{output_column}`"),
              "form": F.coalesce(F.col(f"`{form_column}`"), F.lit("plain"))}
    return _mapped(arranged, inputs, RESTORED, rows)


# Code points are the units of length, substring and strpos here too.
ORACLE_SQL = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
h AS (
    SELECT *, length(x)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda p: list_sum(
        list_transform(range(8), lambda i: (strpos('0123456789abcdef', substring(h, p + i, 1)) - 1)
                                           * (1::BIGINT << (4 * (7 - i)))))::BIGINT) AS k
    FROM t),
f AS (
    SELECT doc_id, x, n, least(k[1] % (n + 1), k[2] % (n + 1)) AS a,
           greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>')
                     OR k[3] % 100 >= 90 THEN 'plain'
                WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h),
p AS (
    SELECT *, '<P>' || substring(x, 1, a) AS pre, '<M>' || substring(x, a + 1, b - a) AS mid,
           '<S>' || substring(x, b + 1, n - b) AS suf
    FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN pre || suf || mid
              ELSE suf || pre || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""
