import pytest
from pyspark.sql import functions as F

from tierlift.functions import clean, naming
from tierlift.functions.text import (
    normalise_text, stop_words, tokens, unigrams_and_bigrams,
)
from tierlift.plans.oracle import DOMAIN, ENGLISH


def one(spark, value, kind, fn):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [
    ("  x  ", "x"), ("", None), (None, None), ("\t\n a b \n", "a b"), (" x ", "x")])
def test_clean_string(spark, raw, want):
    assert one(spark, raw, "string", clean.clean_string) == want


@pytest.mark.parametrize("raw, want", [
    ("123.45", 123.45), ("invalid", None), ("nan", None), ("inf", None), ("-Infinity", None),
    ("1d", None), ("0x1p3", None), ("1_000", 1000.0), (" 7 ", 7.0), (None, None), (".5", 0.5),
    ("5.", 5.0), ("1e3", 1000.0), ("1__0", None)])
def test_clean_float(spark, raw, want):
    assert one(spark, raw, "string", clean.clean_float) == want


def test_infinity_is_kept_for_profiles(spark):
    kept = one(spark, "-inf", "string", lambda c: clean.clean_float(c, keep_infinity=True))
    assert kept == float("-inf")


@pytest.mark.parametrize("raw, want", [
    ("10", 10), ("10.7", 10), ("-10.7", -10), ("abc", 0), (None, 0), ("inf", 0)])
def test_clean_int(spark, raw, want):
    assert one(spark, raw, "string", clean.clean_int) == want


@pytest.mark.parametrize("raw, want", [
    ("true", True), ("false", False), ("null", False), ("0", False), ("2", True), ("0.0", False),
    ('""', False), ('"false"', True), ("[]", False), ("[0]", True), ("{}", False)])
def test_truthy(spark, raw, want):
    assert one(spark, raw, "string", lambda c: clean.truthy_variant(F.parse_json(c))) is want


def test_fold_dynamic_keys_skips_incomplete_ids(spark):
    df = spark.createDataFrame(
        [({"stars_1": "5", "score_1": "9", "stars_2": "4", "name": "x", "hidden": "1"}, [1, 2, 3])],
        "m map<string,string>, jobs array<int>")
    row = df.select(
        clean.fold_dynamic_keys(F.col("m"), F.col("jobs"), ["stars", "score"]).alias("j"),
        clean.drop_prefixed_keys(clean.drop_keys(F.col("m"), ["hidden", "absent"]),
                                 ["stars", "score"]).alias("rest")).first()
    assert [(j["id"], j["stars"], j["score"]) for j in row["j"]] == [(1, "5", "9")]
    assert row["rest"] == {"name": "x"}


def test_names(spark):
    df = spark.createDataFrame([(["b", "A", "c"],)], "m array<string>")
    row = df.select(naming.bundle_name(F.col("m")).alias("n"),
                    naming.json_list(F.array_sort("m")).alias("j")).first()
    assert (row["n"], row["j"]) == ("A + b + c", '["A","b","c"]')
    back = df.select(naming.parse_json_list(naming.json_list(F.col("m"))).alias("b")).first()
    assert back["b"] == ["b", "A", "c"]


def test_text_normal_form(spark):
    got = one(spark, "See HTTPS://x.y/z?a=1 now: C++ & C#,  .NET-core", "string",
              normalise_text)
    assert got == "see now c++ c# .net-core"


def test_tokens_drop_short_and_stop_words_before_bigrams(spark):
    def terms(c):
        return unigrams_and_bigrams(tokens(c, ["the"]))
    assert one(spark, "red the c++ blue .net", "string", terms) == [
        "red", "blue", "net", "red blue", "blue net"]
    assert one(spark, "", "string", terms) == []


def test_stop_words_agree_with_the_sql_side(spark):
    assert stop_words() == sorted(set(ENGLISH) | set(DOMAIN))
