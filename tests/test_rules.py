"""Tagging, hints and filters on small cases and on the caption recipe."""

import re

import pytest
from pyspark.sql import functions as F

from scenelake.functions import rules, text
from scenelake.functions import taxonomy as T
from scenelake.operators import coverage, evaluation
from scenelake.sources import tables

CASES = [
    ("no hazard ahead", "hazard_level", "high"),
    ("no incident was logged", "hazard_level", "none"),
    ("pedestrians and trucks", "agent_type", ["none"]),
    ("headlights in the early morning", "time_of_day", "night"),
    ("fog and rain", "weather", "rain"),
    ("on a highway approaching a junction", "road_type", "highway"),
    ("visibility is\npoor", "weather", "unknown"),
    ("visibility is poor", "weather", "fog"),
    ("a dog, a bus and a cyclist", "agent_type", ["cyclist", "bus", "animal"]),
    ("", "traffic_density", "unknown"),
    (None, "ego_action", ["none"]),
]


@pytest.fixture(scope="module")
def tagged_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "clip_id int, text string")
    return {r.clip_id: r for r in coverage.tagged(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_tag_cases(tagged_cases, i):
    assert tagged_cases[i][CASES[i][1]] == CASES[i][2]


def reference_tags(caption: str) -> dict:
    out = {}
    for field, table in T.TAG_RULES.items():
        hits = [v for v, patterns in table if any(re.search(p, caption.lower()) for p in patterns)]
        out[field] = (hits or ["none"]) if field in T.MULTI else (hits or ["unknown"])[0]
    return out


def test_tags_equal_plain_python(spark, sf):
    captions = {r.clip_id: r.text for r in tables.captions(spark, sf).collect()}
    for r in coverage.tagged(tables.captions(spark, sf)).collect():
        assert {f: r[f] for f in T.FIELDS} == reference_tags(captions[r.clip_id])


def test_rule_table_sizes():
    assert sum(len(p) for t in T.TAG_RULES.values() for _, p in t) == 190
    assert [len(t) for t in T.TAG_RULES.values()] == [4, 5, 7, 3, 7, 4, 8]


def test_coverage_goldens_at_200_rows(spark, sf):
    tags = coverage.tagged(tables.captions(spark, sf))
    rate = coverage.coverage_rate(tags).first()
    assert (rate.n_possible, rate.n_covered, rate.n_zero) == (560, 98, 462)
    assert coverage.combinations(tags).count() == 184
    assert coverage.observed(coverage.continuous(tags)).count() == 79


def test_tagging_is_one_projection_without_python(spark, sf):
    plan = coverage.tagged(tables.captions(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "WholeStageCodegen" in plan or "*(1)" in plan


def test_query_hints(spark):
    rows = {r.qid: r for r in evaluation.query_hints(tables.queries(spark)).collect()}
    assert len(rows) == 60
    assert sorted(q for q, r in rows.items() if not r.hinted) == ["L0-16", "L1-04", "L1-05", "L1-10", "L2-10", "L2-15", "L4-01"]
    assert (rows["L3-04"].time_of_day, rows["L3-04"].road_type, rows["L3-04"].agent_type) == ("dusk", "intersection", "pedestrian")
    assert (rows["L2-01"].weather, rows["L2-01"].agent_type, rows["L2-01"].hazard_level) == ("rain", "pedestrian", "high")
    assert rows["L1-07"].weather == "snow" and rows["L4-05"].weather == "fog"


def test_filter_semantics(spark):
    rows = spark.createDataFrame([(1, "rain", ["bus", "dog"]), (2, None, ["truck"]), (3, "fog", None)], "clip_id int, weather string, agent_type array<string>")
    ids = lambda w: [r.clip_id for r in rows.where(rules.matches(w)).orderBy("clip_id").collect()]
    assert ids({"weather": "rain"}) == [1]
    assert ids({"weather": ["rain", "fog"]}) == [1, 3]
    assert ids({"weather": "unknown"}) == [2]
    assert ids({"agent_type": ["truck", "dog"]}) == [1, 2]
    assert ids({"weather": []}) == []
    assert ids({"agent_type": "unknown"}) == [3]


def test_text_functions(spark):
    rows = spark.createDataFrame([("a  nighttime night\n b", ), (None,), ("",)], "text string")
    got = rows.select(text.word_count(F.col("text")).alias("n"), text.substring_count(F.col("text"), "night").alias("k")).collect()
    assert [(r.n, r.k) for r in got] == [(4, 2), (0, 0), (0, 0)]
    one = spark.createDataFrame([("The children play near a School", "near a school"), ("x", "a an of")], "text string, q string")
    assert [r[0] for r in one.select(text.keyword_relevance(F.col("text"), F.col("q"))).collect()] == [True, False]
    words = spark.createDataFrame([("The Éclair and x of été_2",)], "text string").select(text.tokens(F.col("text"))).first()[0]
    assert words == ["éclair", "été_2"]


def test_continuous_values(spark):
    rows = coverage.continuous(coverage.tagged(spark.createDataFrame([(1, "at night in heavy rain on a highway with a truck and a bus and a dog and a cyclist"), (2, "")], "clip_id int, text string")))
    a, b = rows.orderBy("clip_id").collect()
    assert (a.visibility_level, a.precipitation_intensity, a.agent_density, a.lighting_level, a.road_type_encoded, a.traffic_density_cont) == (0.6, 0.65, 0.85, 0.08, 0.92, None)
    assert b.visibility_level is None and b.agent_density == 0.05
