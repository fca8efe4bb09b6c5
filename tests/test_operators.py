"""Retrieval, evaluation, density and clusters on worked cases."""

import math

import numpy as np
import pytest

from scenelake.operators import cluster, coverage, density, evaluation, retrieval
from scenelake.operators.search import SearchEngine
from scenelake.plans import catalogue
from scenelake.sources import tables


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "fog on road"), (2, "rain rain road road road truck"), (3, "sunny day"), (4, "")], "doc_id long, text string")


def test_bm25_by_hand(spark, docs):
    queries = spark.createDataFrame([("a", "rain road"), ("b", "zebra"), ("c", "rain rain")], "qid string, text string")
    got = {(r.qid, r.doc_id): (r.score, r.rank) for r in retrieval.bm25(docs, queries, 10).collect()}
    avgdl = (2 + 6 + 2 + 0) / 4
    part = lambda df, tf, dl: math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))
    assert got[("a", 2)] == (pytest.approx(part(1, 2, 6) + part(2, 3, 6), abs=1e-6), 1)
    assert got[("a", 1)][0] == pytest.approx(part(2, 1, 2), abs=1e-6)
    assert got[("c", 2)][0] == pytest.approx(2 * part(1, 2, 6), abs=1e-6)
    assert not any(q == "b" for q, _ in got)
    full = retrieval.padded(retrieval.bm25(docs, queries, 3), docs, queries, 3).collect()
    assert sorted((r.qid, r.rank) for r in full) == [(q, i) for q in "abc" for i in (1, 2, 3)]


def test_vector_search_equals_numpy(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(300, 8))
    rows = [(i, m[i].tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    asked = [(str(i), m[i].tolist()) for i in range(0, 300, 100)]
    got = retrieval.vector_search(vectors, asked, 5, block=2).orderBy("qid", "rank").collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q, _ in asked:
        want = np.argsort(-np.round(unit @ unit[int(q)], 6), kind="stable")[:5].tolist()
        assert [x.doc_id for x in got if x.qid == q] == want
    assert retrieval.vector_search(vectors, [], 5).count() == 0


def test_hybrid_and_fallback(spark, sf):
    from scenelake.plans import catalogue as c

    tags, vectors = c.tags(spark, sf), c.vectors(spark, sf)
    v = c.vector_of(spark, sf, 0)
    some = retrieval.hybrid(tags, vectors, v, c.NIGHT_TRUCK, 10).collect()
    assert {r.method for r in some} == {"hybrid"} and len(some) == 10
    fits = {r.clip_id for r in tags.collect() if r.time_of_day == "night" and "truck" in r.agent_type}
    assert {r.doc_id for r in some} <= fits
    none = retrieval.hybrid(tags, vectors, v, {"weather": []}, 3).orderBy("rank").collect()
    assert [r.method for r in none] == ["embedding"] * 3 and none[0].doc_id == 0
    assert retrieval.hybrid(tags, vectors, v, None, 3).first().fallback


def test_engine(spark, sf):
    from scenelake.plans import catalogue as c

    captions, tags, vectors = tables.captions(spark, sf), c.tags(spark, sf), c.vectors(spark, sf)
    engine = SearchEngine(captions, tags, vectors)
    v = c.vector_of(spark, sf, 0)
    for method in ("bm25", "embedding", "hybrid"):
        rows, ms = engine.timed("night rain", v, method, 3, {"weather": "rain"}, True)
        assert len(rows) == 3 and ms > 0 and rows[0].text
    assert engine.clip_detail(5).count() == 1 and engine.clip_detail(-1).count() == 0
    assert engine.fields().count() == 39 and engine.coverage().count() == 7 and all(engine.health().values())
    with pytest.raises(ValueError):
        engine.search("", v)
    with pytest.raises(ValueError):
        engine.search("x", v, top_k=101)


def test_metrics(spark):
    ranked = spark.createDataFrame([("m", "q", i, r) for r, i in enumerate([9, 1, 8, 2, 7], 1)] + [("m", "z", 1, 1)], "method string, qid string, clip_id long, rank int")
    labels = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3)], "qid string, clip_id long")
    got = {r.qid: r for r in evaluation.metrics(ranked, labels, 5).collect()}
    assert (got["q"].recall, got["q"].mrr, got["q"].n_relevant) == (pytest.approx(2 / 3, abs=1e-6), 0.5, 3)
    assert set(got) == {"q"}  # a query without labels enters no mean
    timings = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 6.0), ("n", None)], "method string, ms double")
    assert {tuple(r) for r in evaluation.latency(timings).collect()} == {("m", 3, 3.0, 2.0), ("n", 0, None, None)}


def test_plans_tag_once_and_multiply_nothing(spark, sf):
    plan = lambda name: catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for name in ("odd_coverage_rate", "odd_gap_axis_counts", "odd_zero_cells", "odd_heat_weather_road"):
        assert "CartesianProduct" not in plan(name)
    patterns = plan("odd_tags").count("RLIKE")
    assert patterns and plan("odd_any_unknown").count("RLIKE") <= patterns and plan("gap_score_7d").count("RLIKE") <= 2 * patterns  # the model, and the rows it scores


def test_saved_index(spark, sf, tmp_path):
    docs = tables.captions(spark, sf).withColumnRenamed("clip_id", "doc_id")
    retrieval.save_index(docs, str(tmp_path))
    key = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())
    assert key(retrieval.saved_bm25(spark, str(tmp_path), tables.queries(spark))) == key(retrieval.bm25(docs, tables.queries(spark)))


def test_kde_by_hand(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.3, 0.0]), (3, None), (4, [None, 1.0])], "id long, x array<double>")
    got = {r.id: r.log_density for r in density.kde(rows, rows, 0.3).collect()}
    assert math.exp(got[1]) == pytest.approx((1 + math.exp(-0.5)) / (2 * 2 * math.pi * 0.09))
    assert got[3] is None and got[4] is None
    assert density.kde(rows, rows.limit(0), 0.3).where("log_density is not null").count() == 0


def test_long_tail_excludes_ties(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(20)], "id long, density double")
    assert density.long_tail(rows).count() == 0


def test_gaussian_fallback_for_small_clusters(spark):
    rows = spark.createDataFrame([(i, 0 if i < 10 else 1, float(i)) for i in range(12)], "id long, cluster int, a double")
    got = {r.cluster: r for r in density.gaussian(rows, ["a"], "cluster").collect()}
    assert got[0].mu_a == 4.5 and got[1].mu_a == 5.5  # two rows only: the mean of all
    near = density.nearest(rows, density.gaussian(rows, ["a"], "cluster").drop("n"), ["a"], "id", "cluster").collect()
    assert {r.id: r.nearest_cluster for r in near}[11] == 1


def test_clusters_and_magnitude(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (60, 2)) for c in ((0, 0), (3, 3), (0, 4))] + [r.uniform(-9, 9, (20, 2))])
    labels = cluster.density_labels(x, 20, 5)
    assert sorted(set(labels.tolist())) == [-1, 0, 1, 2] and all(len(set(labels[i : i + 60].tolist()) - {-1}) == 1 for i in (0, 60, 120))
    assert cluster.magnitude(np.zeros((3, 2)))[0] in (3.0, pytest.approx(1.0))
    assert 1 <= cluster.magnitude(x[:50])[0] <= 50
    points = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, labels))], "id long, x array<double>, cluster int")
    found = cluster.cluster_profile(points).collect()
    assert len(found) == 3 and all(1 <= p.magnitude <= p.size for p in found)
    assert cluster.density_clusters(points, 20, 5).where("cluster >= 0").select("cluster").distinct().count() == 3
    projected, share = cluster.pca(points, 2)
    assert projected.count() == 200 and sum(share) == pytest.approx(1)
    again = cluster.standardise(points.selectExpr("id", "x[0] as a", "1.0D as b"), ["a", "b"]).selectExpr("avg(a) m", "stddev_pop(a) s", "max(b) z").first()
    assert abs(again.m) < 1e-9 and again.s == pytest.approx(1) and again.z == 0


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for name, body in (("b.txt", "two\nlines"), ("a.txt", "one")):
        (tmp_path / "c" / name).write_text(body)
    (tmp_path / "c" / "a.mp4").write_bytes(b"xx")
    assert [(r.clip_id, r.text) for r in tables.caption_files(spark, str(tmp_path / "c"), limit=5).collect()] == [("a", "one"), ("b", "two\nlines")]
    assert tables.caption_files(spark, str(tmp_path / "c"), limit=1).count() == 1
    assert [r.clip_id for r in tables.video_files(spark, str(tmp_path / "c")).collect()] == ["a"]
    (tmp_path / "tags.json").write_text('{"k": {"weather": "rain", "agent_type": ["bus"]}}')
    row = tables.tag_map(spark, str(tmp_path / "tags.json")).first()
    assert (row.clip_id, row.weather, row.agent_type, row.road_type) == ("k", "rain", ["bus"], None)
    for kind in ("parquet", "json", "csv"):
        tables.write(spark.range(3), str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    tables.publish(spark, str(tmp_path), "exp=2")
    assert tables.active(spark, str(tmp_path)).endswith("/exp=2")


def test_stream_tags_new_files(spark, tmp_path):
    from scenelake.streaming import ingest

    rows = spark.createDataFrame([(1, "at night in rain"), (2, "a dog")], "clip_id long, text string").selectExpr("*", "timestamp'2024-01-01 00:30:00' as at")
    rows.write.parquet(str(tmp_path / "in"))
    ingest.start(ingest.tag_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.clip_id: r.weather for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "rain", 2: "unknown"}
    counts = ingest.windowed_counts(ingest.tag_stream(spark, str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").selectExpr("sum(n)").first()[0] == 2


def test_empty_captions(spark):
    tags = coverage.tagged(spark.createDataFrame([], "clip_id long, text string"))
    assert coverage.distribution(tags).count() == 0 and coverage.zero_cells(tags).count() == 560
