"""Cleaning rules for raw strings, numbers and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number syntax that counts as parsable.
NUMBER_PATTERN = (
    r"^[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
FALSY_JSON = r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE][+-]?[0-9]+)?)$'
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"


def clean_string(c: Column) -> Column:
    """Strip Unicode whitespace on both ends; blank becomes null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def clean_float(c: Column, keep_infinity: bool = False) -> Column:
    """Parse a number or return null. NaN is always null; infinity unless kept."""
    text = clean_string(c)
    parsed = F.when(
        text.rlike(NUMBER_PATTERN), F.regexp_replace(text, "_", "").try_cast("double")
    )
    infinite = F.when(
        text.rlike(INFINITY_PATTERN),
        F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )
    value = F.coalesce(parsed, infinite)
    if keep_infinity:
        return value
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def clean_double(c: Column, keep_infinity: bool = False) -> Column:
    """The same rule for a column that is already a double."""
    value = F.when(~F.isnan(c), c)
    if keep_infinity:
        return value
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def clean_int(c: Column) -> Column:
    """Truncate toward zero; missing, bad or infinite input becomes 0."""
    return F.coalesce(clean_float(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def float_or_zero(c: Column) -> Column:
    return F.coalesce(clean_float(c), F.lit(0.0))


def string_or(c: Column, fallback: Column) -> Column:
    return F.coalesce(clean_string(c), fallback)


def truthy_variant(c: Column) -> Column:
    """Any non-empty string, non-zero number, true or non-empty container is true."""
    return F.coalesce(~F.to_json(c).rlike(FALSY_JSON), F.lit(False))


def strict_flag_variant(c: Column) -> Column:
    """Boolean cast of a JSON flag; anything that is not a boolean reads as false."""
    return F.coalesce(F.try_variant_get(c, "$", "boolean"), F.lit(False))


def truthy_text(c: Column) -> Column:
    """The string case of the truthiness rule: any non-empty text is true."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def drop_keys(m: Column, names: list[str]) -> Column:
    """Drop a fixed list of keys from a map; names that are absent are ignored."""
    banned = F.array(*[F.lit(n) for n in names])
    return F.map_filter(m, lambda k, _: ~F.array_contains(banned, k))


def fold_dynamic_keys(m: Column, ids: Column, fields: list[str]) -> Column:
    """Turn ``<field>_<id>`` keys of a map into an array of ``{id, field…}`` structs.

    Ids for which any of the keys is missing are skipped.
    """
    def entry(i: Column) -> Column:
        parts = [F.try_element_at(m, F.concat(F.lit(f"{f}_"), i.cast("string"))).alias(f)
                 for f in fields]
        return F.struct(i.alias("id"), *parts)

    def complete(i: Column) -> Column:
        ok = F.lit(True)
        for f in fields:
            ok = ok & F.map_contains_key(m, F.concat(F.lit(f"{f}_"), i.cast("string")))
        return ok

    return F.transform(F.filter(ids, complete), entry)


def drop_prefixed_keys(m: Column, fields: list[str]) -> Column:
    """Remove the dynamic keys that were left over after folding."""
    def keep(k: Column, _: Column) -> Column:
        ok = F.lit(True)
        for f in fields:
            ok = ok & ~k.startswith(f"{f}_")
        return ok

    return F.map_filter(m, keep)
