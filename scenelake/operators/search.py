"""The search service's operations over prepared tables, each returning a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import taxonomy as T
from scenelake.operators import coverage, density, retrieval
from scenelake.sources import tables

METHODS = ("bm25", "embedding", "hybrid")


@dataclass
class SearchEngine:
    """captions (clip_id, text), tags (clip_id, fields) and vectors (doc_id, embedding) of one published version."""

    captions: DataFrame
    tags: DataFrame
    vectors: DataFrame

    def search(self, query: str, vector: list[float] | None = None, method: str = "hybrid", top_k: int = 10, odd_filter: dict | None = None, captions: bool = False) -> DataFrame:
        """Ranked clips. Any method but bm25 and embedding is hybrid; the query has 1 to 512 characters, top_k is 1 to 100."""
        if not 1 <= len(query) <= 512 or not 1 <= top_k <= 100:
            raise ValueError("query must have 1 to 512 characters and top_k be 1 to 100")
        spark = self.captions.sparkSession
        if method == "bm25":
            asked = spark.createDataFrame([("q", query)], "qid string, text string")
            out = retrieval.bm25(self.captions.withColumnRenamed("clip_id", "doc_id"), asked, top_k).select("doc_id", "score", "rank", F.lit("bm25").alias("method"))
        elif vector is None:
            raise ValueError("vector methods need the query's vector")
        elif method == "embedding":
            out = retrieval.vector_search(self.vectors, [("q", vector)], top_k).select("doc_id", F.col("cosine").alias("score"), "distance", "rank", F.lit("embedding").alias("method"))
        else:
            out = retrieval.hybrid(self.tags, self.vectors, vector, odd_filter, top_k).withColumnRenamed("cosine", "score")
            shown = self.tags.withColumnRenamed("clip_id", "doc_id")
            out = out.join(shown, "doc_id", "left")
            out = out.select(*[c for c in out.columns if c not in T.FIELDS], F.when(~F.col("fallback"), F.struct(*T.FIELDS)).alias("tags"))
        if captions:
            out = out.join(self.captions.withColumnRenamed("clip_id", "doc_id"), "doc_id", "left")
        return out.withColumnRenamed("doc_id", "clip_id")

    def timed(self, *args, **kwargs) -> tuple[list, float]:
        """The collected top rows of search(), and milliseconds."""
        began = time.perf_counter()
        rows = self.search(*args, **kwargs).orderBy("rank").collect()
        return rows, round((time.perf_counter() - began) * 1000, 2)

    def clip_detail(self, clip_id) -> DataFrame:
        """Caption and tags of one clip; no row if it is not known."""
        return self.captions.where(F.col("clip_id") == clip_id).join(self.tags, "clip_id", "left")

    def fields(self) -> DataFrame:
        return tables.taxonomy(self.captions.sparkSession)

    def coverage(self) -> DataFrame:
        return coverage.coverage_percent(self.tags)

    def long_tail(self, points: DataFrame) -> DataFrame:
        """points (id, x of two numbers): those below the fifth percentile of density."""
        densities = density.kde(points, points, density.BANDWIDTH_2D).select("id", F.exp("log_density").alias("density"))
        return density.long_tail(densities)

    def health(self) -> dict[str, bool]:
        """Which tables have a row."""
        return {name: not getattr(self, name).isEmpty() for name in ("captions", "tags", "vectors")}
