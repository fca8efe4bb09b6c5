"""Outside services (labelling, extraction, relevance): any callable can be plugged in, called from the executors.

A factory makes the client once for each partition; a client takes a dict and returns a dict. A call that raises is
tried again; what still fails takes the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import taxonomy as T
from scenelake.operators import coverage

Client = Callable[[dict], dict]
TRIES = 3


def ask(rows: DataFrame, factory: Callable[[], Client], answer: dict[str, str], default: dict, tries: int = TRIES) -> DataFrame:
    """rows with a column for each answer (name -> SQL type), and `failed`."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def call(client: Client, row: dict) -> dict:
        for _ in range(tries):
            try:
                got = client(row)
                return {k: got.get(k, default.get(k)) for k in answer} | {"failed": False}
            except Exception:  # noqa: BLE001  whatever a service raises
                continue
        return {k: default.get(k) for k in answer} | {"failed": True}

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for frame in frames:
            got = pd.DataFrame([call(client, r) for r in frame.to_dict("records")], columns=[*answer, "failed"], index=frame.index)
            yield pd.concat([frame, got], axis=1)

    return rows.mapInPandas(answers, f"{kinds}, " + ", ".join(f"{k} {t}" for k, t in answer.items()) + ", failed boolean")


def label_unknown(tags: DataFrame, captions: DataFrame, factory: Callable[[], Client], batch: int | None = None, characters: int = 2000) -> DataFrame:
    """Tags with the unknown single ones filled by a service; batch bounds how many clips are asked for, least ids first."""
    wanting = tags.where(coverage.any_unknown()).select("clip_id").orderBy("clip_id")
    wanting = wanting.limit(batch) if batch is not None else wanting
    rows = captions.join(wanting, "clip_id", "left_semi").select("clip_id", F.substring("text", 1, characters).alias("text"))
    asked = ask(rows, factory, dict.fromkeys(T.SINGLE, "string"), dict.fromkeys(T.SINGLE, "unknown"))
    return coverage.merge_tags(tags, asked)


def extract_numbers(numbers: DataFrame, captions: DataFrame, factory: Callable[[], Client], every: bool = False, characters: int = 2000) -> DataFrame:
    """The seven numbers from a service for rows with a null (or for every row), held between 0 and 1; failed rows stay as they were."""
    missing = F.lit(every)
    for d in T.DIMENSIONS:
        missing = missing | F.col(d).isNull()
    rows = captions.join(numbers.where(missing).select("clip_id"), "clip_id", "left_semi").select("clip_id", F.substring("text", 1, characters).alias("text"))
    asked = ask(rows, factory, {f"{d}_": "double" for d in T.DIMENSIONS}, {f"{d}_": 0.5 for d in T.DIMENSIONS}).where("not failed").drop("text", "failed")
    new = lambda d: F.when(F.col("asked_"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f"{d}_", F.lit(0.5))))).otherwise(F.col(d)).alias(d)
    joined = numbers.join(asked.withColumn("asked_", F.lit(True)), "clip_id", "left").withColumn("asked_", F.coalesce("asked_", F.lit(False)))
    return joined.select("clip_id", *map(new, T.DIMENSIONS), F.when(F.col("asked_"), F.lit("llm")).otherwise(F.col("source")).alias("source"))


def score_pairs(pairs: DataFrame, captions: DataFrame, queries: DataFrame, factory: Callable[[], Client]) -> DataFrame:
    """qid, clip_id, condition_score, causal_score, relevant for candidate pairs (qid, clip_id); a failed call scores zero."""
    rows = pairs.select("qid", "clip_id").join(captions, "clip_id").join(F.broadcast(queries.select("qid", "level", F.col("text").alias("query"))), "qid")
    asked = ask(rows, factory, {"condition_score": "int", "causal_score": "int"}, {"condition_score": 0, "causal_score": 0})
    enough = F.when(F.col("level").isin("L2", "L3"), F.col("condition_score") + F.col("causal_score") >= 3).otherwise(F.col("condition_score") >= 2)
    return asked.select("qid", "clip_id", "condition_score", "causal_score", enough.alias("relevant"))


def pending(wanted: DataFrame, done: DataFrame, key: str, source: str = "llm") -> DataFrame:
    """What a resumed run still has to ask: keys without an answer of that source."""
    return wanted.join(done.where(F.col("source") == source).select(key), key, "left_anti")
