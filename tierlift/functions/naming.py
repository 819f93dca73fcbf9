"""Display strings: bundle names, counted labels, topic titles, JSON lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bundle_name(members: Column) -> Column:
    """Members in byte order joined by `` + ``."""
    return F.array_join(F.array_sort(members), " + ")


def json_list(members: Column) -> Column:
    return F.to_json(members)


def parse_json_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def counted(name: Column, n: Column) -> Column:
    return F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")"))


def weighted(word: Column, weight: Column) -> Column:
    return F.concat(word, F.lit(" ("), F.round(weight, 2).cast("string"), F.lit(")"))


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, whatever stands before it (``3d-print`` is ``3D-Print``)."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
    gaps = F.split(low, r"\p{L}+", -1)
    return F.array_join(F.zip_with(gaps, runs, lambda gap, run: F.concat(
        gap, F.coalesce(F.concat(F.upper(F.substring(run, 1, 1)), F.substring(
            run, F.lit(2), F.length(run))), F.lit("")))), "")


def topic_label(number: Column, words: Column) -> Column:
    """``Topic k: A / B / C`` with every word in title case."""
    return F.concat(
        F.lit("Topic "), number.cast("string"), F.lit(": "),
        F.array_join(F.transform(words, title_case), " / "),
    )


def joined_text(*parts: Column) -> Column:
    """Parts separated by one space, stripped at the ends only."""
    glued = parts[0]
    for p in parts[1:]:
        glued = F.concat(glued, F.lit(" "), p)
    return F.trim(glued)


def guarded_ratio(num: Column, den: Column, default: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))
