"""Corpus profile: matched files, length statistics and histogram, keyword counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import taxonomy as T
from scenelake.functions.text import bucket, substring_count, word_count


def lengths(docs: DataFrame) -> DataFrame:
    n = word_count(F.col("text")).cast("long")
    return docs.select(n.alias("n")).agg(F.count("*").alias("n_docs"), F.min("n").alias("min_words"), F.max("n").alias("max_words"), F.round(F.avg("n"), 1).alias("mean_words"))


def histogram(docs: DataFrame, width: int = 50) -> DataFrame:
    return docs.select(bucket(word_count(F.col("text")), width).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def keyword_counts(docs: DataFrame, keywords: list[str] = T.PROFILE_KEYWORDS) -> DataFrame:
    """keyword, n: one scan with one sum a keyword, then turned to rows."""
    sums = docs.agg(*[F.coalesce(F.sum(substring_count(F.col("text"), k)), F.lit(0)).cast("long").alias(f"k{i}") for i, k in enumerate(keywords)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, k in enumerate(keywords)])).alias("x")).select("x.*")


def matched_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of either side, of both, and of one only; one shuffle on the key."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return both.agg(
        F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_matched"),
        F.count_if(F.col("r").isNull()).alias("n_left_only"), F.count_if(F.col("l").isNull()).alias("n_right_only"),
    )
