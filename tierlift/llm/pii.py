"""Personal data and the terms that give it away.

Base findings are matches of fixed patterns (email, ip, card, phone). Each distinct value is a
protected entity. How strongly a term reveals an entity is estimated from the whole corpus, as
in information-theoretic sanitisation: the pointwise mutual information
PMI(term; entity) = log(p(entity | term) / p(entity)) is compared with the information
IC(entity) = -log p(entity). A term discloses an entity if PMI >= alpha * IC and they meet in
at least ``support`` different texts. Where it discloses everything (PMI = IC: the term occurs
nowhere else) it is removed, else generalised to ``[TERM]``.

Probabilities are shares of documents: term and entity meet in every document that holds both,
at any distance and beside any other identifier, words have any length, and a disclosing term
goes wherever it occurs in a document that holds its entity. Words inside identifiers are not
terms. A document without personal data never changes. An entity found in fewer than ``support``
texts has no disclosing terms, however telling its surroundings are.

All of it is DataFrame functions. Texts are known by their MD5; equal texts are looked at once
and count once.

Defined cases: a null text is an empty one and has no findings; repeated rows each get their
row; an empty table gives an empty one; outputs replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlift.llm.common import drop_stored, fresh_name, stored, whole_text
from tierlift.session import broadcast_if_small

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, written so that matching takes linear time and no deep recursion: what
# follows a possessive part cannot begin with what it takes, and a match that would fail at the
# start of a run of characters fails at all later ones.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this character has no match.
HINTS = {"email": "@", "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ANY_WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]*+"
SUPPORT = 3
ALPHA = 0.98
SPAN = "array<struct<start: int, end: int, value: string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``(start, end, value)`` in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        low = a.getField("at") + F.length(x.getField("gap"))
        high = low + F.length(x.getField("hit"))
        span = F.struct(low.alias("start"), high.alias("end"), x.getField("hit").alias("value"))
        return F.struct(high.alias("at"), F.concat(a.getField("out"), F.array(span)).alias("out"))

    # The gap behind the last match has none beside it.
    pairs = F.filter(F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))),
                     lambda x: x.getField("hit").isNotNull())
    return F.aggregate(pairs, start, add, lambda a: a.getField("out"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def step(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), step), F.lit(0),
                        lambda a, d: a + d)
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Matches of one kind that hold, with the entity they name as value."""
    found = F.filter(matches(text, PATTERNS[kind]), lambda x: _holds(kind, x.getField("value")))
    if kind in HINTS:
        found = F.when(F.contains(text, F.lit(HINTS[kind])), found).otherwise(
            F.array().cast(SPAN))

    def named(x: Column) -> Column:
        v = x.getField("value")
        name = {"email": F.lower(v), "ip": v}.get(kind, _digits(v))
        return F.struct(x.getField("start").alias("start"), x.getField("end").alias("end"),
                        F.concat(F.lit(kind + ":"), name).alias("value"))

    return F.transform(found, named)


def _blanked(text: Column, places: Column) -> Column:
    """The text with blanks in place of ascending spans, so that offsets stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        at, low, high = a.getField("at"), x.getField("start"), x.getField("end")
        piece = F.concat(F.substring(text, at + 1, F.greatest(low - at, F.lit(0))),
                         F.repeat(F.lit(" "), high - F.greatest(low, at)))
        return F.when(high <= at, a).otherwise(F.struct(
            high.alias("at"), F.concat(a.getField("out"), F.array(piece)).alias("out")))

    return F.aggregate(places, start, add, lambda a: F.concat(
        F.array_join(a.getField("out"), ""),
        F.substring(text, a.getField("at") + 1, F.length(text))))


def findings(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Per different text: ``(text_id, base, rest)``; ``base`` by kind, then start.

    ``rest`` is the text without its identifiers, null if there are none.
    """
    text = F.col("text")
    rows = docs.select(whole_text(f"`{text_column}`").alias("text"))
    kinds = rows.select("text", *[base_spans(text, k).alias(k) for k in KINDS])

    def of_kind(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(
            F.lit(kind).alias("kind"),
            *[x.getField(c).alias(c) for c in ("start", "end", "value")]))

    spans = kinds.select("text", F.concat(*[of_kind(k) for k in KINDS]).alias("base"))
    ordered = spans.select("text", "base", F.array_sort(F.transform("base", lambda x: F.struct(
        *[x.getField(c).alias(c) for c in ("start", "end", "value")]))).alias("places"))
    rest = F.when(F.size("places") > 0, _blanked(text, F.col("places"))).alias("rest")
    return stored(ordered.select(F.md5("text").alias("text_id"), "base", rest)
                  .dropDuplicates(["text_id"]))


def _words(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0))
    return F.array_distinct(F.transform(words, F.lower))


def disclosing_terms(docs: DataFrame, found: DataFrame, alpha: float, support: int,
                            text_column: str = "text") -> DataFrame:
    """``(text_id, term, ratio)``: terms that disclose an entity of the text, by documents.

    Entities, then pairs, found in too few texts go before anything is joined to them. Copies
    of a text are weights; support counts texts once.
    """
    copies = docs.select(F.md5(whole_text(f"`{text_column}`")).alias("text_id")).groupBy(
        "text_id").agg(F.count(F.lit(1)).alias("copies"))
    holds = stored(found.where("rest is not null").select(
        "text_id", F.explode(F.array_distinct("base.value")).alias("entity")).join(
        copies, "text_id"))
    entities = stored(holds.groupBy("entity").agg(
        F.sum("copies").alias("shown"), F.count(F.lit(1)).alias("texts")).where(
        F.col("texts") >= support).select("entity", "shown"))
    linked = stored(holds.join(entities, "entity").select("text_id", "copies", "entity"))
    words = found.join(linked.select("text_id").distinct(), "text_id").select(
        "text_id", F.explode(_words(F.col("rest"))).alias("term"))
    pairs = stored(words.join(linked, "text_id").groupBy("entity", "term").agg(
        F.sum("copies").alias("together"), F.count(F.lit(1)).alias("texts")).where(
        F.col("texts") >= support))
    terms = broadcast_if_small(stored(pairs.select("term").distinct()))
    uses = docs.select(F.explode(_words(whole_text(f"`{text_column}`"))).alias("term")).join(
        terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    total = docs.select(F.count(F.lit(1)).alias("total"))
    joined = pairs.join(entities, "entity").join(uses, "term").join(total)  # one row
    given = F.least(F.col("together") / F.col("uses"), F.lit(1.0))
    rare = -F.log(F.least(F.col("shown") / F.col("total"), F.lit(1.0)))
    ratio = F.when(rare > 0, 1 + F.log(given) / rare)
    bad = stored(joined.select("entity", "term", ratio.alias("ratio")).where(
        F.col("ratio") >= alpha))
    out = stored(linked.join(bad, "entity").groupBy("text_id", "term").agg(
        F.max("ratio").alias("ratio")))
    drop_stored(holds, entities, linked, pairs, bad)
    return out


def _all_places(found: DataFrame, terms: DataFrame) -> DataFrame:
    """``(text_id, start, end, term, ratio)`` of every occurrence of the terms of a text."""
    texts = found.join(terms.select("text_id").distinct(), "text_id").select("text_id", "rest")
    hits = F.regexp_extract_all("rest", F.lit(ANY_WORD), F.lit(0))
    pieces = F.arrays_zip(hits.alias("hit"), F.split("rest", ANY_WORD, -1).alias("gap"))
    rows = texts.select("text_id", F.posexplode(pieces).alias("at", "x")).select(
        "text_id", "at", "x.hit", "x.gap").where("hit is not null")
    so_far = Window.partitionBy("text_id").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("gap") + F.length("hit")).over(so_far).cast("int")
    placed = rows.select("text_id", F.lower("hit").alias("term"), end.alias("end"),
                         (end - F.length("hit")).alias("start"))
    return placed.join(terms, ["text_id", "term"])


def _label(x: Column) -> Column:
    kind = x.getField("kind")
    return F.when(kind != "term", F.concat(F.lit("["), F.upper(kind), F.lit("]"))).when(
        x.getField("ratio") >= 1, F.lit("")).otherwise(F.lit("[TERM]"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced; of spans that overlap the first one counts."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x.getField("start").alias("start"), (-x.getField("end")).alias("back"),
        _label(x).alias("label"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        at, out, low = a.getField("at"), a.getField("out"), x.getField("start")
        piece = F.concat(F.substring(text, at + 1, low - at), x.getField("label"))
        return F.when(low < at, a).otherwise(F.struct(
            (-x.getField("back")).alias("at"), F.concat(out, F.array(piece)).alias("out")))

    return F.aggregate(ordered, start, add, lambda a: F.concat(
        F.array_join(a.getField("out"), ""),
        F.substring(text, a.getField("at") + 1, F.length(text))))


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT,
             text_column: str = "text") -> DataFrame:
    """Add ``base_spans``, ``term_spans`` and ``sanitised`` to the documents.

    Spans are ``(kind, start, end, value, ratio)``, base ones by kind and start, terms by start.
    """
    found = findings(docs, text_column)
    terms = disclosing_terms(docs, found, alpha, support, text_column)
    hit = _all_places(found, terms)
    spans = stored(hit.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct(
        F.lit("term").alias("kind"), "start", "end", F.col("term").alias("value"), "ratio")))
        .alias("term_spans")))
    base = F.transform("base", lambda x: F.struct(
        *[x.getField(c).alias(c) for c in ("kind", "start", "end", "value")],
        F.lit(None).cast("double").alias("ratio")))
    none = F.array().cast("array<struct<kind: string, start: int, end: int, value: string, "
                          "ratio: double>>")
    known = stored(found.join(spans, "text_id", "left").select(
        "text_id", base.alias("base_spans"), F.coalesce("term_spans", none).alias("term_spans")))
    drop_stored(spans, found, terms)
    key = fresh_name(docs, "text_id")
    outputs = ["base_spans", "term_spans", "sanitised"]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in outputs]).withColumn(
        key, F.md5(whole_text(f"`{text_column}`")))
    joined = rows.join(known.withColumnRenamed("text_id", key), key).drop(key)
    return joined.withColumn("sanitised", _replaced(
        whole_text(f"`{text_column}`"), F.concat("base_spans", "term_spans")))
