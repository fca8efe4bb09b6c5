"""Tags and what they cover: coverage, distribution, pivots, combinations and the empty ones among them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import rules
from scenelake.functions import taxonomy as T

AXES = ("time_of_day", "weather", "road_type", "hazard_level")


def tagged(captions: DataFrame) -> DataFrame:
    """clip_id and a column for each field; one pass over the text, no Python.

    The lower-cased text and the values found each leave through a generator of one row, so that whatever uses them
    refers to columns. In a plain projection every pattern would be given its own copy of the expression that makes
    the text, and every filter and sum over a tag its own copy of the patterns.
    """
    once = lambda *columns: F.inline(F.array(F.struct(*columns)))
    lowered = captions.select("clip_id", once(rules.lowered(F.col("text")).alias("lowered")))
    found = lowered.select("clip_id", once(*[rules.found(f, F.col("lowered")) for f in T.FIELDS]))
    return found.select("clip_id", *[rules.settled(f, F.col(f)) for f in T.FIELDS])


def _long(tags: DataFrame, every: bool = False) -> DataFrame:
    """field, value: the first value of fields with several, or every one."""
    if every:
        named = lambda f: F.transform(F.col(f) if f in T.MULTI else F.array(f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
        cells = F.concat(*map(named, T.FIELDS))
    else:
        cells = F.array(*[F.struct(F.lit(f).alias("field"), (F.element_at(f, 1) if f in T.MULTI else F.col(f)).alias("value")) for f in T.FIELDS])
    return tags.select(F.explode(cells).alias("x")).select("x.*")


def coverage_percent(tags: DataFrame) -> DataFrame:
    """field, coverage_pct: rows whose (first) value is known; none counts as known."""
    known = F.count_if(F.col("value") != "unknown")
    return _long(tags).groupBy("field").agg(F.round(known * 100.0 / F.count("*"), 1).alias("coverage_pct"), F.count("*").alias("n"))


def distribution(tags: DataFrame, every: bool = False) -> DataFrame:
    return _long(tags, every).groupBy("field", "value").agg(F.count("*").alias("n"))


def bands(coverage: DataFrame) -> DataFrame:
    pct = F.col("coverage_pct")
    return coverage.select("field", "coverage_pct", F.when(pct >= 80, "high").when(pct >= 50, "medium").otherwise("low").alias("band"))


def by_action(tags: DataFrame) -> DataFrame:
    """time_weather, action, n: clips by time and weather for every action."""
    actions = F.coalesce(F.col("ego_action"), F.array(F.lit("straight")))
    cells = tags.select(F.concat_ws("x", "time_of_day", "weather").alias("time_weather"), F.explode(actions).alias("action"))
    return cells.groupBy("time_weather", "action").agg(F.count("*").alias("n"))


def pivot_action(tags: DataFrame) -> DataFrame:
    """One column for each action, absent ones 0; the values are stated, so that no job has to find them."""
    actions = F.coalesce(F.col("ego_action"), F.array(F.lit("straight")))
    cells = tags.select(F.concat_ws("x", "time_of_day", "weather").alias("time_weather"), F.explode(actions).alias("action"))
    return cells.groupBy("time_weather").pivot("action", [*T.FIELDS["ego_action"], "none"]).count().na.fill(0)


def combinations(tags: DataFrame, axes: tuple = AXES) -> DataFrame:
    return tags.groupBy(*[F.coalesce(a, F.lit("unknown")).alias(a) for a in axes]).agg(F.count("*").alias("n"))


def possible(spark, axes: tuple = AXES) -> DataFrame:
    """Every combination of taxonomy values (a few hundred rows, made here), with the place of each value."""
    rows = [tuple(x for v, i in cell for x in (v, i)) for cell in product(*([(v, i) for i, v in enumerate(T.FIELDS[a])] for a in axes))]
    return spark.createDataFrame(rows, ", ".join(f"{a} string, {a}_ord int" for a in axes)).coalesce(1)


def zero_cells(tags: DataFrame, axes: tuple = AXES, first: int | None = None) -> DataFrame:
    """Combinations that do not occur; with `first` so many of them, in the order of the taxonomy."""
    empty = possible(tags.sparkSession, axes).join(combinations(tags, axes), list(axes), "left_anti")
    return (empty if first is None else empty.orderBy(*[f"{a}_ord" for a in axes]).limit(first)).select(*axes)


def coverage_rate(tags: DataFrame, axes: tuple = AXES) -> DataFrame:
    """Combinations inside the taxonomy that occur, of all that are possible; unknown ones don't count."""
    found = possible(tags.sparkSession, axes).join(combinations(tags, axes), list(axes), "left")
    covered = F.count("n")
    return found.agg(F.count("*").alias("n_possible"), covered.alias("n_covered"), (F.count("*") - covered).alias("n_zero"), F.round(covered / F.count("*"), 4).alias("coverage_rate"))


def heat_map(tags: DataFrame, rows: str, columns: str) -> DataFrame:
    """Both axes, count and whether the cell is a gap, for all taxonomy values."""
    n = F.coalesce("n", F.lit(0))
    counted = combinations(tags, (rows, columns))
    return possible(tags.sparkSession, (rows, columns)).join(counted, [rows, columns], "left").select(rows, columns, n.cast("long").alias("n"), (n == 0).alias("gap"))


def gap_axis_counts(tags: DataFrame, axes: tuple = AXES) -> DataFrame:
    """axis, value, n over the empty combinations, all of them."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes]))
    return zero_cells(tags, axes).select(cells.alias("x")).select("x.*").groupBy("axis", "value").agg(F.count("*").alias("n"))


def extreme_combinations(tags: DataFrame, n: int = 50, axes: tuple = AXES, most: bool = True) -> DataFrame:
    order = [F.desc("n") if most else F.asc("n"), *axes]
    return combinations(tags, axes).orderBy(*order).limit(n)


def continuous(tags: DataFrame) -> DataFrame:
    return tags.select("clip_id", *rules.dimensions(), F.lit("regex").alias("source"))


def null_counts(numbers: DataFrame) -> DataFrame:
    counted = numbers.agg(*[F.count_if(F.col(d).isNull()).alias(d) for d in T.DIMENSIONS])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("n_null")) for d in T.DIMENSIONS])).alias("x")).select("x.*")


def observed(numbers: DataFrame) -> DataFrame:
    return numbers.dropna(subset=T.DIMENSIONS)


def fill_missing(numbers: DataFrame, clips: DataFrame) -> DataFrame:
    """A row for every clip; those without numbers have nulls and the source missing."""
    return clips.select("clip_id").join(numbers, "clip_id", "left").withColumn("source", F.coalesce("source", F.lit("missing")))


def merge_tags(tags: DataFrame, other: DataFrame) -> DataFrame:
    """Unknown single tags take the value of other (from a labelling service, say)."""
    theirs = other.select("clip_id", *[F.col(f).alias(f"{f}_") for f in T.SINGLE])
    keep = lambda f: F.when(F.col(f) == "unknown", F.coalesce(f"{f}_", f)).otherwise(F.col(f)).alias(f)
    return tags.join(theirs, "clip_id", "left").select("clip_id", *[keep(f) if f in T.SINGLE else F.col(f) for f in T.FIELDS])


def any_unknown() -> Column:
    out = F.lit(False)
    for f in T.SINGLE:
        out = out | (F.col(f) == "unknown")
    return out
