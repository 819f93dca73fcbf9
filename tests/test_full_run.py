"""A full run over raw pages, with the invariants every result has to satisfy."""

import json
import math
import random

import pytest

from tierlift.params import Thresholds
from tierlift.plans.run_all import run

ITEMS = ["Python", "Django", "HTML", "CSS", "SEO", "Writing", "Excel", "Design", "Go", "Rust"]
WORDS = ("server cloud backend api data models pages layout brand copy articles sheets ledger "
         "forms budget logo poster theme deploy scale").split()


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    pages, out = tmp_path_factory.mktemp("pages"), tmp_path_factory.mktemp("out")
    rng = random.Random(11)
    people = []
    for i in range(400):
        held = rng.sample(ITEMS, rng.randint(3, 8))
        earned = round(math.exp(rng.gauss(6, 1)) * (3 if {"Go", "Rust"} <= set(held) else 1), 2)
        words = " ".join(rng.choices(WORDS, k=30))
        people.append({
            "user_id": i, "username": f"u{i}", "total_earnings": earned,
            "hourlyrate": str(rng.randint(5, 90)), "no_reviews": rng.randint(0, 40),
            "country": rng.choice(["A", "B", "C", "D", "E", "F", ""]), "city": rng.choice("xy"),
            "location": {"lat": 1.0, "lon": 2.0}, "user_profile": words, "tagline": "hello",
            "skills": [{"skill_id": ITEMS.index(k), "skill_name": k, "is_user_skill": True}
                       for k in held],
            "portfolios": [{"title": "t", "description": "d"}]})
    for page in range(0, 400, 50):
        rows = people[page:page + 50]
        if page:
            rows = rows + [dict(people[page - 1], total_earnings=0)]
        (pages / f"{page}.json").write_text(json.dumps(rows))
    (pages / "broken.json").write_text('[{"user_id": 1')
    limits = Thresholds(min_edge_weight=60, regression_bundles=4, topics=3)
    return run(spark, str(pages), str(out), limits), out


def test_invariants(spark, outcome):
    made, out = outcome
    ent = made["entities"].toPandas()
    assert len(ent) == 400 and 0.08 <= ent.is_top.mean() <= 0.12
    assert abs(ent.log_metric - ent.metric.map(math.log1p)).max() < 1e-9
    files = spark.read.json(f"{out}/profile/files").first()
    assert (files["total_files"], files["malformed_files"]) == (9, 1)
    assert spark.read.parquet(f"{out}/profile/conflicts").count() == 7
    bundles = made["bundles"].toPandas()
    assert bundles.support.between(0, 1).all() and (bundles.lift > 0).all()
    assert bundles.p_value.between(0, 1).all() and (bundles.ci_upper >= bundles.ci_lower).all()
    for name in ("nodes", "edges", "communities", "terms", "regions", "localities"):
        assert made[name].count() > 0, name
    assert made["topics"].count() == 3 and made["regressions"].count() == 4
    regions = made["regions"].toPandas()
    assert "Unknown" not in set(regions.region) and regions.top_items.str.contains(r"\(").all()


def test_summary_document(spark, outcome):
    made, out = outcome
    doc = spark.read.json(f"{out}/summary").first().asDict(recursive=True)
    assert set(doc) == {"overview", "top_bundles", "popular_items", "items_by_rate",
                        "communities", "top_terms", "topics", "regions", "regressions"}
    counts = [r["entity_count"] for r in doc["popular_items"]]
    assert len(counts) == 5 and counts == sorted(counts, reverse=True)
    assert spark.read.parquet(f"{out}/status").count() == len(made)
