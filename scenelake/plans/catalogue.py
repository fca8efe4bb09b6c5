"""Every named query over the test tables, with its SQL where SQL can express it.

Names match on both sides; numbers that depend on the order of sums are rounded on both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import rules
from scenelake.functions import taxonomy as T
from scenelake.operators import cluster, coverage, density, evaluation, profile, retrieval
from scenelake.plans import sql as S
from scenelake.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Columns of the vectors that stand for a ten-dimensional projection.
DIMS = [f"e{i}" for i in range(10)]


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, d):
    return tables.table(spark, d, "documents")


def tags(spark, d):
    return coverage.tagged(tables.captions(spark, d))


def numbers(spark, d):
    return coverage.continuous(tags(spark, d))


def vectors(spark, d):
    return tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_of(spark, d, i: int) -> list[float]:
    return vectors(spark, d).where(F.col("doc_id") == i).first().embedding


def asked_vectors(spark, d) -> list[tuple]:
    """The stated query set: every row whose id is divisible by 100."""
    rows = vectors(spark, d).where(F.col("doc_id") % 100 == 0).select("doc_id", "embedding").toLocalIterator()
    return [(str(r.doc_id), r.embedding) for r in rows]


def points(spark, d, width: int):
    return vectors(spark, d).select(F.col("doc_id").alias("id"), F.slice(retrieval.unit(), 1, width).alias("x"), "label")


def projected(spark, d):
    return vectors(spark, d).select(F.col("doc_id").alias("id"), F.col("label").alias("cluster"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMS)])


# profile -------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_docs, min(n) AS min_words, max(n) AS max_words, round(avg(n), 1) AS mean_words FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM documents)")
def corpus_profile(spark, d):
    return profile.lengths(documents(spark, d))


@query("SELECT n // 50 * 50 AS bucket, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM documents) GROUP BY 1")
def length_histogram(spark, d):
    return profile.histogram(documents(spark, d))


@query("SELECT k AS keyword, sum((length(lower(text)) - length(replace(lower(text), k, ''))) // length(k))::BIGINT AS n FROM documents, (SELECT unnest(" + S.strings(T.PROFILE_KEYWORDS) + ") AS k) GROUP BY k")
def keyword_counts(spark, d):
    return profile.keyword_counts(documents(spark, d))


@query("SELECT count(l) AS n_left, count(r) AS n_right, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS n_matched, count(*) FILTER (r IS NULL) AS n_left_only, count(*) FILTER (l IS NULL) AS n_right_only FROM (SELECT DISTINCT doc_id AS l FROM documents) FULL JOIN (SELECT DISTINCT vec_id AS r FROM embeddings) ON l = r")
def id_match_summary(spark, d):
    return profile.matched_ids(documents(spark, d).select("doc_id"), vectors(spark, d).select("doc_id"), "doc_id")


# tags and coverage ---------------------------------------------------------------------------------------------


@query(S.with_captions("SELECT clip_id, text FROM captions"))
def captions(spark, d):
    return tables.captions(spark, d)


@query(S.with_tags("SELECT clip_id, time_of_day, weather, road_type, traffic_density, hazard_level, array_to_string(agent_type, '|') AS agents, array_to_string(ego_action, '|') AS actions FROM tags"))
def odd_tags(spark, d):
    return tags(spark, d).select("clip_id", *T.SINGLE, F.concat_ws("|", "agent_type").alias("agents"), F.concat_ws("|", "ego_action").alias("actions"))


@query(S.with_tags(f"SELECT field, round(count(*) FILTER (value <> 'unknown') * 100.0::DOUBLE / count(*), 1) AS coverage_pct, count(*) AS n FROM ({S.FIRST_VALUES}) GROUP BY field"))
def odd_coverage_pct(spark, d):
    return coverage.coverage_percent(tags(spark, d))


@query(S.with_tags(f"SELECT field, pct AS coverage_pct, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' ELSE 'low' END AS band FROM (SELECT field, round(count(*) FILTER (value <> 'unknown') * 100.0::DOUBLE / count(*), 1) AS pct FROM ({S.FIRST_VALUES}) GROUP BY field)"))
def odd_coverage_bands(spark, d):
    return coverage.bands(coverage.coverage_percent(tags(spark, d)))


@query(S.with_tags(f"SELECT field, value, count(*) AS n FROM ({S.FIRST_VALUES}) GROUP BY 1, 2"))
def odd_tag_distribution(spark, d):
    return coverage.distribution(tags(spark, d))


@query(S.with_tags(f"SELECT field, value, count(*) AS n FROM ({S.ALL_VALUES}) GROUP BY 1, 2"))
def odd_tag_distribution_all(spark, d):
    return coverage.distribution(tags(spark, d), every=True)


@query(S.with_tags("SELECT time_of_day || 'x' || weather AS time_weather, action, count(*) AS n FROM (SELECT *, unnest(ego_action) AS action FROM tags) GROUP BY 1, 2"))
def odd_pivot_action(spark, d):
    return coverage.by_action(tags(spark, d))


@query(S.with_tags("SELECT time_of_day || 'x' || weather AS time_weather, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in [*T.FIELDS["ego_action"], "none"]) + " FROM (SELECT *, unnest(ego_action) AS action FROM tags) GROUP BY 1"))
def odd_pivot_action_wide(spark, d):
    return coverage.pivot_action(tags(spark, d))


@query(S.with_tags("SELECT time_of_day, weather, road_type, hazard_level, count(*) AS n FROM tags GROUP BY ALL"))
def odd_combo_counts(spark, d):
    return coverage.combinations(tags(spark, d))


@query(S.with_tags(f"SELECT p.* FROM ({S.POSSIBLE}) p ANTI JOIN tags USING (time_of_day, weather, road_type, hazard_level)"))
def odd_zero_cells(spark, d):
    return coverage.zero_cells(tags(spark, d))


@query(S.with_tags(f"SELECT 560::BIGINT AS n_possible, count(*) AS n_covered, 560 - count(*) AS n_zero, round(count(*) / 560.0::DOUBLE, 4) AS coverage_rate FROM ({S.POSSIBLE}) p SEMI JOIN tags USING (time_of_day, weather, road_type, hazard_level)"))
def odd_coverage_rate(spark, d):
    return coverage.coverage_rate(tags(spark, d))


def _heat(rows, columns):
    return S.with_tags(f"SELECT {rows}, {columns}, count(clip_id) AS n, count(clip_id) = 0 AS gap FROM (SELECT * FROM (SELECT unnest({S.strings(T.FIELDS[rows])}) AS {rows}), (SELECT unnest({S.strings(T.FIELDS[columns])}) AS {columns})) LEFT JOIN tags USING ({rows}, {columns}) GROUP BY 1, 2")


@query(_heat("weather", "road_type"))
def odd_heat_weather_road(spark, d):
    return coverage.heat_map(tags(spark, d), "weather", "road_type")


@query(_heat("time_of_day", "road_type"))
def odd_heat_time_road(spark, d):
    return coverage.heat_map(tags(spark, d), "time_of_day", "road_type")


@query(S.with_tags(f"SELECT axis, value, count(*) AS n FROM (UNPIVOT (SELECT p.* FROM ({S.POSSIBLE}) p ANTI JOIN tags USING (time_of_day, weather, road_type, hazard_level)) ON COLUMNS(*) INTO NAME axis VALUE value) GROUP BY 1, 2"))
def odd_gap_axis_counts(spark, d):
    return coverage.gap_axis_counts(tags(spark, d))


@query(S.with_tags("SELECT time_of_day, weather, road_type, hazard_level, count(*) AS n FROM tags GROUP BY ALL ORDER BY n DESC, 1, 2, 3, 4 LIMIT 50"))
def odd_top_combos(spark, d):
    return coverage.extreme_combinations(tags(spark, d))


@query(S.with_tags("SELECT time_of_day, weather, road_type, hazard_level, count(*) AS n FROM tags GROUP BY ALL ORDER BY n, 1, 2, 3, 4 LIMIT 50"))
def odd_bottom_combos(spark, d):
    return coverage.extreme_combinations(tags(spark, d), most=False)


@query(S.with_numbers("SELECT * FROM numbers"))
def odd_continuous(spark, d):
    return numbers(spark, d)


@query(S.with_numbers("SELECT dimension, n_null FROM (UNPIVOT (SELECT " + ", ".join(f"count(*) FILTER ({x} IS NULL) AS {x}" for x in T.DIMENSIONS) + " FROM numbers) ON COLUMNS(*) INTO NAME dimension VALUE n_null)"))
def odd_null_counts(spark, d):
    return coverage.null_counts(numbers(spark, d))


@query(S.with_numbers("SELECT clip_id FROM numbers WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in T.DIMENSIONS)))
def odd_fully_observed(spark, d):
    return coverage.observed(numbers(spark, d)).select("clip_id")


@query(S.with_numbers("SELECT c.clip_id, visibility_level, coalesce(source, 'missing') AS source FROM captions c LEFT JOIN (SELECT * FROM numbers WHERE clip_id % 7 <> 3) n ON c.clip_id = n.clip_id"))
def odd_fill_missing(spark, d):
    return coverage.fill_missing(numbers(spark, d).where("clip_id % 7 <> 3"), tables.captions(spark, d)).select("clip_id", "visibility_level", "source")


@query(S.with_tags("SELECT clip_id, " + ", ".join(f"CASE WHEN {f} = 'unknown' AND clip_id % 2 = 0 THEN '{T.FIELDS[f][0]}' ELSE {f} END AS {f}" for f in T.SINGLE) + " FROM tags"))
def odd_merge_labels(spark, d):
    """Unknown tags filled from a labelling service; here a stand-in that labels every other clip."""
    given = tables.captions(spark, d).where("clip_id % 2 = 0").select("clip_id", *[F.lit(T.FIELDS[f][0]).alias(f) for f in T.SINGLE])
    return coverage.merge_tags(tags(spark, d), given).select("clip_id", *T.SINGLE)


@query(S.with_tags("SELECT clip_id FROM tags WHERE " + " OR ".join(f"{f} = 'unknown'" for f in T.SINGLE)))
def odd_any_unknown(spark, d):
    return tags(spark, d).where(coverage.any_unknown()).select("clip_id")


# retrieval -----------------------------------------------------------------------------------------------------


@query(S.with_tokens("documents", "doc_id", "SELECT (SELECT count(*) FROM tok) AS n_docs, (SELECT round(avg(dl), 6) FROM tok) AS avgdl, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM tok)"))
def bm25_index_stats(spark, d):
    return retrieval.index_stats(documents(spark, d))


@query(S.bm25(10))
def bm25_topk(spark, d):
    found = retrieval.bm25(tables.captions(spark, d).withColumnRenamed("clip_id", "doc_id"), tables.queries(spark), 10)
    return found.select("qid", "doc_id", "score", "rank")


def _cosines(which: str) -> str:
    return f"SELECT q.vec_id AS q, v.vec_id AS doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v, (SELECT * FROM embeddings WHERE {which}) q"


@query(f"SELECT '0' AS qid, doc_id, cosine, row_number() OVER (ORDER BY cosine DESC, doc_id) AS rank FROM ({_cosines('vec_id = 0')}) QUALIFY rank <= 10")
def vector_topk(spark, d):
    return retrieval.vector_search(vectors(spark, d), [("0", vector_of(spark, d, 0))], 10).select("qid", "doc_id", "cosine", "rank")


@query(f"SELECT q::VARCHAR AS qid, doc_id, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc_id) AS rank FROM ({_cosines('vec_id % 100 = 0')}) QUALIFY rank <= 10")
def vector_topk_batch(spark, d):
    return retrieval.vector_search(vectors(spark, d), asked_vectors(spark, d), 10).select("qid", "doc_id", "cosine", "rank")


def _dots() -> str:
    return "SELECT v.vec_id AS doc_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id = 0) q"


NIGHT_TRUCK = {"time_of_day": "night", "agent_type": "truck"}


@query(S.with_tags(f"SELECT doc_id, cosine, 'hybrid' AS method, false AS fallback, row_number() OVER (ORDER BY cosine DESC, doc_id) AS rank FROM ({_dots()}) JOIN tags ON doc_id = clip_id WHERE time_of_day = 'night' AND list_contains(agent_type, 'truck') QUALIFY rank <= 10"))
def hybrid_topk(spark, d):
    return retrieval.hybrid(tags(spark, d), vectors(spark, d), vector_of(spark, d, 0), NIGHT_TRUCK, 10)


@query(f"SELECT doc_id, cosine, 'embedding' AS method, true AS fallback, row_number() OVER (ORDER BY cosine DESC, doc_id) AS rank FROM ({_dots()}) QUALIFY rank <= 10")
def hybrid_fallback(spark, d):
    return retrieval.hybrid(tags(spark, d), vectors(spark, d), vector_of(spark, d, 0), {"weather": "hail"}, 10)


@query(S.with_tags("SELECT clip_id FROM tags WHERE weather = 'rain'"))
def filter_scalar(spark, d):
    return tags(spark, d).where(rules.matches({"weather": "rain"})).select("clip_id")


@query(S.with_tags("SELECT clip_id FROM tags WHERE weather IN ('rain', 'fog') AND time_of_day = 'night'"))
def filter_any_of(spark, d):
    return tags(spark, d).where(rules.matches({"weather": ["rain", "fog"], "time_of_day": "night"})).select("clip_id")


@query(S.with_tags("SELECT clip_id FROM tags WHERE list_has_any(agent_type, ['bus', 'animal'])"))
def filter_array_overlap(spark, d):
    return tags(spark, d).where(rules.matches({"agent_type": ["bus", "animal"]})).select("clip_id")


@query(S.with_tags("SELECT clip_id FROM tags SEMI JOIN embeddings ON clip_id = vec_id"))
def filter_indexed(spark, d):
    return tags(spark, d).select("clip_id").join(vectors(spark, d).select(F.col("doc_id").alias("clip_id")), "clip_id", "left_semi")


# evaluation ----------------------------------------------------------------------------------------------------


@query(S.HINTS)
def query_hints(spark, d):
    return evaluation.query_hints(tables.queries(spark))


def recipe_queries(spark):
    """The stated queries, and some in the words of the captions, which weak labels can hit."""
    return tables.queries(spark).select("qid", "text").unionByName(spark.createDataFrame(T.RECIPE_QUERIES, "qid string, text string"))


@query(S.with_captions(S.WEAK + " SELECT qid, clip_id FROM weak"))
def weak_qrels(spark, d):
    return evaluation.weak_labels(tables.captions(spark, d), recipe_queries(spark))


@query(S.with_captions(S.WEAK + " SELECT qid, clip_id FROM weak QUALIFY count(*) OVER (PARTITION BY qid) >= 30"))
def weak_qrels_min30(spark, d):
    return evaluation.weak_labels(tables.captions(spark, d), recipe_queries(spark), 30)


@query(S.with_captions(S.DRY_RUN + " SELECT qid, sum(condition_score)::BIGINT AS condition_sum, sum(causal_score)::BIGINT AS causal_sum, count(*) FILTER (relevant) AS n_relevant, count(*) AS n FROM scored GROUP BY qid"))
def dryrun_scores(spark, d):
    scored = evaluation.dry_run_scores(tables.captions(spark, d), tables.queries(spark))
    return scored.groupBy("qid").agg(F.sum("condition_score").alias("condition_sum"), F.sum("causal_score").alias("causal_sum"), F.count_if("relevant").alias("n_relevant"), F.count("*").alias("n"))


def _rankings(spark, d, k: int = 10):
    """method, qid, clip_id, rank: by keywords, by encoded vectors, and by vectors among the clips that fit the query's hints."""
    asked, captions = tables.queries(spark), tables.captions(spark, d).withColumnRenamed("clip_id", "doc_id")
    encoded = retrieval.hashing_encoder(captions)
    questions = [(r.doc_id, r.embedding) for r in retrieval.hashing_encoder(asked.select(F.col("qid").alias("doc_id"), "text")).orderBy("doc_id").collect()]  # the stated query set
    fields = [c for c in evaluation.query_hints(asked).columns if c not in ("qid", "hinted")]
    filters = {r.qid: {f: r[f] for f in fields if r[f] is not None} for r in evaluation.query_hints(asked).collect()}
    named = lambda found, m: found.select(F.lit(m).alias("method"), "qid", F.col("doc_id").alias("clip_id"), "rank")
    mixed = retrieval.hybrid_search(tags(spark, d), encoded, questions, filters, k)
    return named(retrieval.bm25(captions, asked, k), "bm25").unionByName(named(retrieval.vector_search(encoded, questions, k), "embedding")).unionByName(named(mixed, "hybrid"))


def _labels(spark, d):
    return evaluation.dry_run_scores(tables.captions(spark, d), tables.queries(spark)).where("relevant").select("qid", "clip_id")


def _scores(spark, d):
    levels = tables.queries(spark).select("qid", "level")
    return evaluation.metrics(_rankings(spark, d), _labels(spark, d)).join(F.broadcast(levels), "qid")


@query(S.scores("SELECT method, qid, n_relevant, recall, mrr FROM scores"))
def eval_recall_mrr(spark, d):
    return evaluation.metrics(_rankings(spark, d), _labels(spark, d))


@query(S.scores("SELECT method, level, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM scores GROUP BY GROUPING SETS ((method, level), (method))"))
def eval_rollup_level(spark, d):
    return evaluation.rollup(_scores(spark, d))


@query(S.scores("SELECT *, gap_second > gap_first AS passed FROM (SELECT " + ", ".join(f"round(coalesce(avg(recall) FILTER (method = 'embedding' AND level = '{v}'), 0) - coalesce(avg(recall) FILTER (method = 'bm25' AND level = '{v}'), 0), 4) AS gap_{n}" for v, n in (("L0", "first"), ("L2", "second"))) + " FROM scores)"))
def eval_method_gap(spark, d):
    return evaluation.method_gap(_scores(spark, d))


@query(S.scores("SELECT count(*) FILTER (hinted) AS n_hinted, count(*) FILTER (hinted AND e <> h) AS n_hinted_differ, count(*) FILTER (hinted AND e = h) AS n_hinted_same, count(*) FILTER (NOT hinted AND e <> h) AS n_plain_differ FROM (SELECT qid, list(clip_id ORDER BY rank) FILTER (method = 'embedding') AS e, list(clip_id ORDER BY rank) FILTER (method = 'hybrid') AS h FROM ranked GROUP BY qid) JOIN hints USING (qid)"))
def eval_divergence(spark, d):
    return evaluation.divergence(_rankings(spark, d), evaluation.query_hints(tables.queries(spark)))


@query(S.scores("SELECT qid, clip_id, origin FROM pool"))
def candidate_pool(spark, d):
    ranked = _rankings(spark, d)
    side = lambda m: ranked.where(F.col("method") == m)
    return evaluation.pool(side("bm25"), side("embedding"), tables.captions(spark, d))


@query(S.scores("SELECT origin, count(*) AS n, count(*) FILTER (relevant) AS n_relevant, round(avg(relevant::INT), 4) AS share FROM pool JOIN scored USING (qid, clip_id) GROUP BY 1"))
def pool_diagnostic(spark, d):
    return evaluation.pooled_set(candidate_pool(spark, d), evaluation.dry_run_scores(tables.captions(spark, d), tables.queries(spark)))[1]


@query(S.scores("SELECT qid, clip_id FROM pool JOIN scored USING (qid, clip_id) WHERE relevant QUALIFY count(*) OVER (PARTITION BY qid) >= 2"))
def pooled_qrels(spark, d):
    return evaluation.pooled_set(candidate_pool(spark, d), evaluation.dry_run_scores(tables.captions(spark, d), tables.queries(spark)), 2)[0]


@query(S.with_tags(f"SELECT p.* FROM ({S.POSSIBLE}) p ANTI JOIN tags USING (time_of_day, weather, road_type, hazard_level) ORDER BY " + ", ".join(f"list_position({S.strings(T.FIELDS[a])}, {a})" for a in coverage.AXES) + " LIMIT 100"))
def odd_zero_cells_first(spark, d):
    return coverage.zero_cells(tags(spark, d), first=100)


# density -------------------------------------------------------------------------------------------------------


@query(f"SELECT id, round(density, 6) AS density FROM ({S.KDE_2D})")
def kde2d_density(spark, d):
    p = points(spark, d, 2)
    return density.kde(p, p, density.BANDWIDTH_2D).select("id", F.round(F.exp("log_density"), 6).alias("density"))


@query(f"SELECT id FROM ({S.KDE_2D}) WHERE round(density, 9) < (SELECT quantile_cont(round(density, 9), 0.05) FROM ({S.KDE_2D}))")
def longtail_p5(spark, d):
    p = points(spark, d, 2)
    return density.long_tail(density.kde(p, p, density.BANDWIDTH_2D).select("id", F.round(F.exp("log_density"), 9).alias("density"))).select("id")


@query(S.KDE_7D)
def kde_loglik_7d(spark, d):
    rows = coverage.observed(numbers(spark, d)).select(F.col("clip_id").alias("id"), density.numbers_vector().alias("x"))
    return density.kde(rows.where("id % 10 = 0"), rows.where("id % 10 <> 0")).agg(F.count("*").alias("n_test"), F.round(F.avg("log_density"), 4).alias("mean_log_density"))


@query(S.with_projection("SELECT cluster, n, " + ", ".join(f"round({s}_{c}, 6) AS {s}_{c}" for s in ("mu", "sd") for c in DIMS) + " FROM centers"))
def cluster_gaussian_params(spark, d):
    found = density.gaussian(projected(spark, d), DIMS, "cluster")
    return found.select("cluster", "n", *[F.round(f"{s}_{c}", 6).alias(f"{s}_{c}") for s in ("mu", "sd") for c in DIMS])


def _centers(spark, d):
    return density.gaussian(projected(spark, d), DIMS, "cluster").drop("n")


@query(S.with_projection("SELECT id, nearest_cluster, round(d2, 6) AS squared_distance FROM closest"))
def nearest_centroid(spark, d):
    return density.nearest(projected(spark, d), _centers(spark, d), DIMS, "id", "cluster").select("id", "nearest_cluster", F.round("squared_distance", 6).alias("squared_distance"))


def _names(spark):
    return spark.createDataFrame([(0, "night rain"), (1, ""), (2, "tunnel exit")], "cluster int, label string")


@query(S.with_projection("SELECT * FROM gaps"))
def semantic_gap_topn(spark, d):
    return density.semantic_gaps(projected(spark, d), _centers(spark, d), DIMS, "id", "cluster", _names(spark), 50)


@query(S.with_projection("SELECT scenario_name, count(*) AS n, count(*) FILTER (is_noise) AS n_noise, count(*) FILTER (NOT is_noise) AS n_edge FROM gaps GROUP BY 1"))
def gap_scenario_counts(spark, d):
    return density.scenario_counts(semantic_gap_topn(spark, d))


@query(S.with_gaps("SELECT * FROM gaps"))
def gap_score_7d(spark, d):
    return density.gap_scores(numbers(spark, d))


@query(S.with_gaps("SELECT dimension, round(mean, 3) AS mean FROM (UNPIVOT (SELECT " + ", ".join(f"avg({x}) AS {x}" for x in T.DIMENSIONS) + " FROM gaps WHERE rank <= 20) ON COLUMNS(*) INTO NAME dimension VALUE mean)"))
def gap_region_mean(spark, d):
    return density.region_mean(gap_score_7d(spark, d))


@query(S.with_gaps("SELECT max(gap_score) AS gap_score_max, round(avg(gap_score), 3) AS gap_score_mean, count(*) AS n FROM gaps"))
def gap_stats(spark, d):
    return gap_score_7d(spark, d).agg(F.max("gap_score").alias("gap_score_max"), F.round(F.avg("gap_score"), 3).alias("gap_score_mean"), F.count("*").alias("n"))


@query(S.with_projection("SELECT least(19, greatest(0, floor((e0 + 1) * 10)))::BIGINT AS x_bin, least(19, greatest(0, floor((e1 + 1) * 10)))::BIGINT AS y_bin, count(*) AS n FROM rows GROUP BY 1, 2"))
def histogram_2d(spark, d):
    cell = lambda c: F.least(F.lit(19), F.greatest(F.lit(0), F.floor((F.col(c) + 1) * 10))).cast("long")
    return projected(spark, d).groupBy(cell("e0").alias("x_bin"), cell("e1").alias("y_bin")).agg(F.count("*").alias("n"))


@query(S.with_projection("SELECT id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in DIMS) + " FROM rows"))
def standard_scaled(spark, d):
    scaled = cluster.standardise(projected(spark, d), DIMS)
    return scaled.select("id", *[F.round(c, 6).alias(c) for c in DIMS])


@query()
def mixture_loglik(spark, d):
    p = points(spark, d, 4)
    return density.mixture(p.where("id % 10 = 0"), p.where("id % 10 <> 0"), 4)


# projection and clusters ---------------------------------------------------------------------------------------


@query()
def pca_project(spark, d):
    return cluster.pca(points(spark, d, 64), 10)[0]


@query()
def kmeans_profile(spark, d):
    return cluster.kmeans(points(spark, d, 64)).groupBy("cluster").agg(F.count("*").alias("size"))


@query()
def hdbscan_profile(spark, d):
    reduced, _ = cluster.pca(points(spark, d, 64), 10)
    return cluster.density_clusters(reduced, 15, 5).groupBy("cluster").agg(F.count("*").alias("size"))


@query()
def cluster_magnitude(spark, d):
    return cluster.cluster_profile(points(spark, d, 64).withColumnRenamed("label", "cluster"))


@query()
def lsh_topk(spark, d):
    return cluster.lsh_search(points(spark, d, 64), vector_of(spark, d, 0))
