"""Retrieval evaluation: relevance labels, candidate pools, Recall@K and MRR@K, and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import rules
from scenelake.functions import taxonomy as T
from scenelake.functions.text import keyword_relevance, long_words

CAUSAL_LEVELS = ["L2", "L3"]


def weak_labels(captions: DataFrame, queries: DataFrame, min_relevant: int = 1) -> DataFrame:
    """qid, clip_id where all long words of the query are in the caption; queries with fewer hits than asked for go.

    The query set is stated and small, so it is sent to every scan task and nothing but hits is shuffled.
    """
    asked = queries.select("qid", F.col("text").alias("query"))
    hits = captions.join(F.broadcast(asked), keyword_relevance(F.col("text"), F.col("query"))).select("qid", "clip_id")
    if min_relevant <= 1:
        return hits
    enough = hits.groupBy("qid").count().where(F.col("count") >= min_relevant).select("qid")
    return hits.join(F.broadcast(enough), "qid", "left_semi")


def dry_run_scores(captions: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, clip_id, condition_score, causal_score, relevant, from words and causal stems alone."""
    asked = queries.select("qid", "level", long_words(F.col("text"), r"\s+").alias("words"))
    lowered = F.lower(F.col("text"))
    hits = F.size(F.filter("words", lambda w: F.contains(F.col("lowered"), w)))
    share = hits / F.greatest(F.size("words"), F.lit(1))
    rows = captions.select("clip_id", lowered.alias("lowered"), rules.contains_any(lowered, T.CAUSAL_STEMS).alias("causal")).join(F.broadcast(asked))
    scored = rows.select("qid", "level", "clip_id", F.when(share >= 0.7, 2).when(share >= 0.4, 1).otherwise(0).alias("condition_score"), F.when(F.col("level").isin(CAUSAL_LEVELS) & F.col("causal"), 1).otherwise(0).alias("causal_score"))
    enough = F.when(F.col("level").isin(CAUSAL_LEVELS), F.col("condition_score") + F.col("causal_score") >= 3).otherwise(F.col("condition_score") >= 2)
    return scored.select("qid", "clip_id", "condition_score", "causal_score", enough.alias("relevant"))


def pool(first: DataFrame, second: DataFrame, corpus: DataFrame, extra: int = 15) -> DataFrame:
    """qid, clip_id, origin: both rankings' clips once each, and `extra` others of the corpus in a fixed pseudo-random order.

    The extra clips come from the first (extra + pool) of that order, which always holds enough.
    """
    ranked = first.select("qid", "clip_id").union(second.select("qid", "clip_id")).distinct()
    most = ranked.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    order = [(F.col("clip_id") * 7919) % 10007, F.col("clip_id")]
    drawn = corpus.select("clip_id").distinct().orderBy(*order).limit(extra + most)
    others = ranked.select("qid").distinct().crossJoin(F.broadcast(drawn)).join(ranked, ["qid", "clip_id"], "left_anti")
    from scenelake.operators.retrieval import top

    others = top(others.withColumn("place", order[0]), extra, best_first=False, by="place", key="clip_id")
    return ranked.withColumn("origin", F.lit("ranked")).unionByName(others.select("qid", "clip_id", F.lit("random").alias("origin")))


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5, by: tuple = ("method", "qid")) -> DataFrame:
    """recall and mrr at k for each method and query of `ranked` (method, qid, clip_id, rank).

    Recall divides by the lesser of k and the number of relevant clips. Queries without any go, so that they enter no mean.
    """
    labels = relevant.select("qid", "clip_id").distinct()
    sizes = labels.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    hits = ranked.where(F.col("rank") <= k).join(labels.withColumn("hit", F.lit(1)), ["qid", "clip_id"], "left")
    found = hits.groupBy(*by).agg(F.count("hit").alias("n_hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    out = found.join(sizes, "qid")
    recall = F.col("n_hits") / F.least(F.lit(k), F.col("n_relevant"))
    return out.select(*by, "n_relevant", F.round(recall, 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def rollup(scores: DataFrame) -> DataFrame:
    """method, level (null: all), n, recall, mrr."""
    return scores.groupingSets([["method", "level"], ["method"]], "method", "level").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr"))


def latency(timings: DataFrame) -> DataFrame:
    """method, n, mean and median of the milliseconds (ms) of its searches."""
    return timings.groupBy("method").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.round(F.median("ms"), 2).alias("median_ms"))


def pooled_set(pooled: DataFrame, scored: DataFrame, min_relevant: int = 1) -> tuple[DataFrame, DataFrame]:
    """The pool's clips (qid, clip_id, origin) judged by a scorer's rows (qid, clip_id, relevant).

    First qid, clip_id of the relevant ones, of queries that have min_relevant of them; then one row for each origin:
    clips, relevant ones and their share. Random clips that are often relevant tell that the pool misses many.
    """
    judged = pooled.join(scored.select("qid", "clip_id", "relevant"), ["qid", "clip_id"])
    kept = judged.where("relevant").select("qid", "clip_id")
    enough = kept.groupBy("qid").agg(F.count("*").alias("n_")).where(F.col("n_") >= min_relevant).select("qid")
    by_origin = judged.groupBy("origin").agg(F.count("*").alias("n"), F.count_if("relevant").alias("n_relevant"), F.round(F.avg(F.col("relevant").cast("int")), 4).alias("share"))
    return kept.join(enough, "qid", "left_semi"), by_origin


def method_gap(scores: DataFrame, levels: tuple = ("L0", "L2")) -> DataFrame:
    """Recall of embedding less that of bm25 at two levels, and whether it grows."""
    mean = lambda m, v: F.coalesce(F.avg(F.when((F.col("method") == m) & (F.col("level") == v), F.col("recall"))), F.lit(0.0))
    gap = lambda v: F.round(mean("embedding", v) - mean("bm25", v), 4)
    a, b = levels
    return scores.agg(gap(a).alias("gap_first"), gap(b).alias("gap_second")).withColumn("passed", F.col("gap_second") > F.col("gap_first"))


def divergence(ranked: DataFrame, hinted: DataFrame) -> DataFrame:
    """Queries with a hint whose hybrid ranking differs from, or equals, the embedding ranking, and those without a hint that differ."""
    lists = ranked.where(F.col("method").isin("embedding", "hybrid")).groupBy("qid").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("method") == m, F.struct("rank", "clip_id")))), lambda x: x["clip_id"]).alias(m) for m in ("embedding", "hybrid")]
    )
    differs = F.col("embedding") != F.col("hybrid")
    rows = lists.join(F.broadcast(hinted.select("qid", "hinted")), "qid")
    return rows.agg(F.count_if("hinted").alias("n_hinted"), F.count_if(F.col("hinted") & differs).alias("n_hinted_differ"), F.count_if(F.col("hinted") & ~differs).alias("n_hinted_same"), F.count_if(~F.col("hinted") & differs).alias("n_plain_differ"))


def query_hints(queries: DataFrame) -> DataFrame:
    fields = list(dict.fromkeys(f for f, _, _ in T.HINT_RULES))
    out = queries.select("qid", *rules.hints(F.col("text")))
    return out.withColumn("hinted", F.coalesce(*fields).isNotNull())
