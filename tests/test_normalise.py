import gzip
import random

import pytest
from pyspark.sql import functions as F

from tierlift.operators import normalise, profiling
from tierlift.plans import queries
from tierlift.sources import raw_json


def raw(spark, rows):
    """Records from ``(file, pos, json text)``."""
    df = spark.createDataFrame(rows, "file string, pos int, json string")
    return raw_json.type_records(df.select("file", "pos", F.parse_json("json").alias("rec")))


@pytest.mark.parametrize("seed", range(3))
def test_keep_best_and_conflicts_equal_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randint(0, 4)}", i, float(rng.randint(0, 3)), rng.randint(0, 3))
            for i in range(200)]
    kept, log = {}, []
    for key, i, metric, size in rows:
        if key in kept:
            old = kept[key]
            log.append((key, i, old[2], size))
            if (metric, size) > (old[1], old[2]):
                kept[key] = (i, metric, size)
        else:
            kept[key] = (i, metric, size)
    df = spark.createDataFrame(rows, "key string, at long, m double, s long")
    best = normalise.keep_best(df, "key", F.col("m"), F.col("s"), ["at"])
    assert {r["key"]: (r["at"], r["m"], r["s"]) for r in best.collect()} == kept
    found = normalise.conflict_log(
        df, "key", F.col("m"), F.col("s"), ["at"], F.floor(F.col("at") / 16))
    assert sorted((r["key"], r["at"], r["existing_items"], r["new_items"])
                  for r in found.collect()) == sorted(log)
    sample = normalise.conflict_sample(found, ["at"], 10).collect()
    assert [r["at"] for r in sample] == sorted(x[1] for x in log)[:10]


def test_first_file_in_lexicographic_order_wins_a_tie(spark):
    recs = raw(spark, [("20", 0, '{"user_id": 1, "total_earnings": "5"}'),
                       ("10", 0, '{"user_id": "1", "total_earnings": 5}'),
                       ("100", 0, '{"user_id": " 1 ", "total_earnings": 5.0}'),
                       ("10", 1, '{"user_id": "  "}')])
    best = normalise.keep_best(recs, "entity_id", F.col("metric").try_cast("double"),
                               F.col("n_items"), ["file", "pos"])
    assert [(r["entity_id"], r["file"]) for r in best.collect()] == [("1", "10")]


def test_links_children_and_text(spark):
    record = """{"user_id": 7, "tagline": " hi ", "user_profile": " does  things ",
      "skills": [{"skill_id": "3.9", "skill_name": " Python ", "is_user_skill": true},
                 {"skill_id": 4, "skill_name": "PYTHON", "is_user_skill": 1},
                 {"skill_id": 5, "skill_name": "Go", "is_user_skill": false},
                 {"skill_name": "  ", "is_user_skill": true}, "junk",
                 {"skill_id": "x", "skill_name": "C++", "is_user_skill": "no"}],
      "portfolios": [{"title": "a", "description": " b "}, {"title": " "}, 3,
                     {"description": "c"}],
      "location": {"lat": "1.5"}, "no_reviews": "12.7", "country": " "}"""
    recs = raw(spark, [("1", 0, record)])
    links = normalise.item_links(recs)
    got = sorted((r["item_id"], r["item_name"]) for r in links.collect())
    assert got == [(0, "C++"), (3, "Python")]
    kids = normalise.child_rows(recs).orderBy("child_id").collect()
    assert [(r["child_id"], r["title"], r["description"]) for r in kids] == [
        (1, "a", "b"), (4, "", "c")]
    text = normalise.assembled_text(recs).first()
    assert text["child_text"] == "a b c"
    assert text["combined_text"] == "hi does  things a b c"
    ent = normalise.entity_table(recs, links).first()
    assert (ent["handle"], ent["display_name"], ent["region"]) == ("7", "7", "Unknown")
    assert (ent["event_count"], ent["latitude"], ent["longitude"]) == (12, 1.5, None)
    assert ent["item_count"] == 2 and ent["metric"] == 0.0 and ent["is_top"] is False
    assert recs.first()["n_items"] == 6


def test_explicit_items_and_every_mention(spark):
    """An item counts as a mention wherever any record holds it explicitly."""
    first = """{"user_id": "w-9", "total_earnings": "12.5", "skills": [
      {"skill_id": 81, "skill_name": "Welding", "is_user_skill": true},
      {"skill_id": 82, "skill_name": " welding ", "is_user_skill": true},
      {"skill_id": 83, "skill_name": "Glazing", "is_user_skill": false}]}"""
    second = """{"user_id": "k-4", "skills": [
      {"skill_id": 83, "skill_name": "Glazing", "is_user_skill": true},
      {"skill_id": 81, "skill_name": "Welding", "is_user_skill": false},
      {"skill_id": 90, "skill_name": "Masonry", "is_user_skill": false}]}"""
    recs = raw(spark, [("a", 0, first), ("a", 1, second), ("b", 0, second)])
    counts = profiling.record_counts(recs).first()
    assert (counts["total_records"], counts["unique_entities"],
            counts["duplicate_entities"]) == (3, 2, 1)
    assert counts["distinct_item_ids"] == 4
    items = {r["item_name"]: (r["explicit_count"], r["mention_count"])
             for r in profiling.item_mentions(recs).collect()}
    assert items == {"Welding": (1, 3), "welding": (1, 1), "Glazing": (2, 3)}


def test_completeness_ignores_null_blank_and_empty(spark):
    df = spark.createDataFrame([('{"a": null, "b": "", "c": [], "d": 0, "e": "[]"}',)], "j string")
    rec = df.select(F.lit("f").alias("file"), F.parse_json("j").alias("rec"))
    found = profiling.field_completeness(raw_json.json_fields(rec)).collect()
    assert sorted(r["field"] for r in found) == ["d", "e"]


def test_pages_lists_objects_and_bad_files(spark, tmp_path):
    for name, body in {"10.json": '[{"user_id": 1}, 5, {"user_id": 2}]',
                       "100.json": '{"user_id": 3}', "20.json": '[{"user_id": 4}',
                       "30.json": '[{"user_id": 5, "country": "A", "country": "B"}]',
                       "40.json": '[{"user_id": 6, "total_earnings": NaN}, {"user_id": 7}]',
                       }.items():
        (tmp_path / name).write_text(body)
    pages = raw_json.read_pages(spark, str(tmp_path), "*.json")
    counts = raw_json.file_counts(pages).first()
    assert (counts["total_files"], counts["malformed_files"]) == (5, 1)
    assert raw_json.bad_files(pages).first()["file"].endswith("20.json")
    recs = raw_json.type_records(raw_json.explode_records(pages)).collect()
    assert sorted((r["entity_id"], r["pos"]) for r in recs) == [
        ("1", 0), ("2", 2), ("3", 0), ("5", 0), ("6", 0), ("7", 1)]
    assert {r["entity_id"]: r["region"] for r in recs}["5"] == "B"


def test_a_page_too_large_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw_json, "PAGE_LIMIT", 8)
    (tmp_path / "1.json").write_text('[{"user_id": 4}, {"user')
    with pytest.raises(Exception, match="page too large"):
        raw_json.bad_files(raw_json.read_pages(spark, str(tmp_path))).collect()


def test_compressed_pages_and_the_limit(spark, tmp_path, monkeypatch):
    with gzip.open(tmp_path / "1.json.gz", "wt") as f:
        f.write('[{"user_id": 4}, {"user_id": 5}]')
    with gzip.open(tmp_path / "2.json.gz", "wt") as f:
        f.write("[" + '{"user_id": 4},' * 1000)
    pages = raw_json.read_pages(spark, str(tmp_path))
    assert raw_json.explode_records(pages).count() == 2
    assert raw_json.file_counts(pages).first()["malformed_files"] == 1
    # The compressed file is below the limit, its text above it.
    monkeypatch.setattr(raw_json, "PAGE_LIMIT", 10_000)
    with pytest.raises(Exception, match="page too large"):
        raw_json.bad_files(raw_json.read_pages(spark, str(tmp_path))).collect()


def test_bad_files_has_two_files_for_each_document(spark, tmp_path, monkeypatch):
    rows = [(i, f"some words {i}\nand a line", "en", "a", 20) for i in range(250)]
    spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "FOLDERS_READ", 3)
    got = queries.bad_files(spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == [(500, 250, 250)]


def test_stream_resumes_and_equals_the_batch(spark, tmp_path, monkeypatch):
    from tierlift.streaming import incremental
    pages, state = tmp_path / "pages", tmp_path / "state"
    pages.mkdir()
    (pages / "10.json").write_text('[{"user_id": 1, "total_earnings": 5}, {"user_id": 2}]')
    incremental.ingest_available(spark, str(pages), str(state))
    (pages / "20.json").write_text('[{"user_id": 1, "total_earnings": 9}]')
    (pages / "30.json").write_text('[{"user_id": 2, "total_earnings": 0, "tagline": "late"}]')
    incremental.ingest_available(spark, str(pages), str(state))
    now = {r["entity_id"]: (r["metric"], r["tagline"])
           for r in incremental.current_records(spark, str(state)).collect()}
    assert now == {"1": ("9", None), "2": (None, None)}
    before = sorted(map(str, incremental.current_records(spark, str(state)).collect()))
    assert len(incremental.State(spark, str(state)).live()) == 2
    assert not list((state / "staged").glob("*"))

    # A compaction that stops before the list is swapped changes nothing, and is cleared later.
    publish = incremental.State.publish
    monkeypatch.setattr(incremental.State, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        incremental.compact(spark, str(state))
    monkeypatch.setattr(incremental.State, "publish", publish)
    assert len(list((state / "compacted").iterdir())) == 1
    assert sorted(map(str, incremental.current_records(spark, str(state)).collect())) == before

    incremental.compact(spark, str(state))
    live = incremental.State(spark, str(state)).live()
    assert len(live) == 1 and live[0].startswith("compacted/")
    assert not list((state / "best").iterdir()) and len(list((state / "compacted").iterdir())) == 1
    assert sorted(map(str, incremental.current_records(spark, str(state)).collect())) == before
    # The load goes on where it was.
    incremental.ingest_available(spark, str(pages), str(state))
    assert sorted(map(str, incremental.current_records(spark, str(state)).collect())) == before
