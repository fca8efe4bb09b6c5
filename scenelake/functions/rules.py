"""Rule tables as Column expressions: whole tables are tagged in one projection inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenelake.functions import taxonomy as T


def any_of(text: Column, patterns: list[str]) -> Column:
    """Any pattern is found in the text."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def found(field: str, text: Column) -> Column:
    """Value of a field in a lower-cased text: the first rule that fires, or an array of all that fire for fields with several values."""
    hits = [F.when(any_of(text, patterns), F.lit(value)) for value, patterns in T.TAG_RULES[field]]
    return (F.array_compact(F.array(*hits)) if field in T.MULTI else F.coalesce(*hits, F.lit("unknown"))).alias(field)


def settled(field: str, value: Column) -> Column:
    """The value found, or none for a field with several values of which none fired."""
    return F.when(F.size(value) == 0, F.array(F.lit("none"))).otherwise(value).alias(field) if field in T.MULTI else value.alias(field)


def tags(text: Column) -> list[Column]:
    return [settled(field, found(field, lowered(text))) for field in T.FIELDS]


def hint(field: str, text: Column) -> Column:
    """The value that a query hints at for a field, by substring; null without one."""
    lowered = F.lower(text)
    rules = [F.when(contains_any(lowered, parts), F.lit(value)) for f, value, parts in T.HINT_RULES if f == field]
    return (F.coalesce(*rules) if rules else F.lit(None).cast("string")).alias(field)


def hints(text: Column) -> list[Column]:
    return [hint(field, text) for field in dict.fromkeys(f for f, _, _ in T.HINT_RULES)]


def agent_density(agents: Column) -> Column:
    n = F.size(F.filter(agents, lambda x: x != "none"))
    none, one, two, more = map(F.lit, T.AGENT_DENSITY)
    return F.when(agents.isNull(), F.lit(None)).when(n <= 0, none).when(n == 1, one).when(n == 2, two).otherwise(more)


def dimension(name: str) -> Column:
    """One number of the continuous vector, from the tag columns; unknown is null."""
    if name == "agent_density":
        return agent_density(F.col("agent_type")).alias(name)
    field, values = T.DIMENSION_MAPS[name]
    return reduce(lambda c, item: c.when(F.col(field) == item[0], F.lit(item[1])), values.items(), F.when(F.lit(False), F.lit(None).cast("double"))).alias(name)


def dimensions() -> list[Column]:
    return [dimension(name) for name in T.DIMENSIONS]


def frequency_weight() -> Column:
    return (1.0 - F.col("visibility_level")) * 0.4 + F.col("precipitation_intensity") * 0.3 + F.col("road_type_encoded") * 0.3


def matches(wanted: dict[str, str | list[str]]) -> Column:
    """The tag filter: every field must agree. A value must equal a single tag or be among several; of a list of
    values any will do, and an empty list matches nothing. A missing tag counts as unknown."""
    tests = []
    for field, value in wanted.items():
        values = [value] if isinstance(value, str) else list(value)
        if not values:
            tests.append(F.lit(False))
        elif field in T.MULTI:
            tests.append(F.arrays_overlap(F.coalesce(F.col(field), F.array(F.lit("unknown"))), F.array(*map(F.lit, values))))
        else:
            tests.append(F.coalesce(F.col(field), F.lit("unknown")).isin(values))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
