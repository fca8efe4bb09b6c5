"""Pluggable services: defaults, retries, merges and resumed runs."""

from scenelake.functions import taxonomy as T
from scenelake.operators import coverage, hooks


def labeller():
    def call(row):
        if "broken" in row["text"]:
            raise RuntimeError("no answer")
        return {"weather": "fog", "time_of_day": "dusk"}

    return call


def test_label_unknown(spark):
    captions = spark.createDataFrame([(1, "at night"), (2, "broken"), (3, "rain")], "clip_id long, text string")
    tags = coverage.tagged(captions)
    got = {r.clip_id: r for r in hooks.label_unknown(tags, captions, labeller).collect()}
    assert (got[1].time_of_day, got[1].weather, got[1].road_type) == ("night", "fog", "unknown")
    assert got[2].weather == "unknown" and (got[3].weather, got[3].time_of_day) == ("rain", "dusk")
    first = {r.clip_id: r for r in hooks.label_unknown(tags, captions, labeller, batch=1).collect()}
    assert first[1].weather == "fog" and first[3].time_of_day == "unknown"


def test_extract_numbers(spark):
    captions = spark.createDataFrame([(1, "x"), (2, "broken")], "clip_id long, text string")
    numbers = coverage.continuous(coverage.tagged(captions))

    def factory():
        def call(row):
            if row["text"] == "broken":
                raise ValueError
            return {"visibility_level_": 7.0, "hazard_proximity_": -1.0}

        return call

    got = {r.clip_id: r for r in hooks.extract_numbers(numbers, captions, factory).collect()}
    assert (got[1].visibility_level, got[1].hazard_proximity, got[1].lighting_level, got[1].source) == (1.0, 0.0, 0.5, "llm")
    assert got[2].source == "regex" and got[2].visibility_level is None and set(T.DIMENSIONS) <= set(got[2].asDict())


def test_score_pairs_and_resume(spark):
    captions = spark.createDataFrame([(1, "a"), (2, "b")], "clip_id long, text string")
    queries = spark.createDataFrame([("q", "L2", "why"), ("p", "L0", "what")], "qid string, level string, text string")
    pairs = spark.createDataFrame([("q", 1), ("q", 2), ("p", 1)], "qid string, clip_id long")
    factory = lambda: lambda row: {"condition_score": 2, "causal_score": int(row["text"] == "a")}
    got = {(r.qid, r.clip_id): r.relevant for r in hooks.score_pairs(pairs, captions, queries, factory).collect()}
    assert got == {("q", 1): True, ("q", 2): False, ("p", 1): True}
    done = spark.createDataFrame([(1, "llm"), (2, "regex")], "clip_id long, source string")
    assert [r.clip_id for r in hooks.pending(captions, done, "clip_id").collect()] == [2]
