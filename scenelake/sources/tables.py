"""Sources and sinks. Schemas are explicit; projections and filters reach the Parquet scan."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from scenelake.functions import taxonomy as T

CAPTION_SUFFIXES = (".caption.txt", ".txt")

TAGS = t.StructType([t.StructField("clip_id", t.StringType())] + [t.StructField(f, t.ArrayType(t.StringType()) if f in T.MULTI else t.StringType()) for f in T.FIELDS])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder where lineages are cut: the one that spark.checkpoint.dir names; a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc.getCheckpointDir()


def clip_id(path: Column, suffixes: tuple = CAPTION_SUFFIXES) -> Column:
    """The file name without the first known suffix that fits, else without its extension."""
    name = F.element_at(F.split(path, "/"), -1)
    known = [F.when(name.endswith(s), F.substring(name, F.lit(1), F.length(name) - len(s))) for s in suffixes]
    return F.coalesce(*known, F.regexp_replace(name, r"\.[^.]*$", ""))


def caption_files(spark: SparkSession, folder: str, suffix: str = ".txt", limit: int | None = None) -> DataFrame:
    """clip_id, text: one row for each caption file; limit keeps the first by id."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}")
    out = files.select(clip_id(F.input_file_name(), (suffix,)).alias("clip_id"), F.col("value").alias("text"))
    return out.orderBy("clip_id").limit(limit) if limit is not None else out


def video_files(spark: SparkSession, folder: str, suffix: str = ".mp4") -> DataFrame:
    """clip_id, path, length: names only, contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(clip_id(F.col("path"), (suffix,)).alias("clip_id"), "path", "length")


def tag_map(spark: SparkSession, path: str) -> DataFrame:
    """Tags from a JSON object of clip id to tags, as rows."""
    fields = t.StructType(TAGS.fields[1:])
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", t.MapType(t.StringType(), fields))).alias("clip_id", "tags"))
    return entries.select("clip_id", "tags.*")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, text: the deterministic captions over the ids of documents."""
    i = F.col("doc_id")
    part = lambda name, at: F.element_at(F.array(*map(F.lit, T.CAPTION_PARTS[name])), (at % len(T.CAPTION_PARTS[name]) + 1).cast("int"))
    div = lambda n: F.floor(i / n).cast("long")
    text = F.concat(
        F.lit("the vehicle drives "), part("T", i), F.lit(" in "), part("W", 3 * i + 2), F.lit(" "), part("R", 5 * i + 1), F.lit(" with "), part("D", 2 * i),
        F.lit(" and "), part("A", 4 * i + 3), F.lit(" ; "), part("H", div(7)), F.lit(" ; the ego "), part("G", div(5)),
    )
    return table(spark, sf_dir, "documents").select(i.alias("clip_id"), text.alias("text"))


def queries(spark: SparkSession) -> DataFrame:
    """qid, level, text, paraphrase_of: the stated query set."""
    return spark.createDataFrame(T.queries(), "qid string, level string, text string, paraphrase_of string")


def taxonomy(spark: SparkSession) -> DataFrame:
    """field, ord, value."""
    return spark.createDataFrame([(f, n, v) for f, values in T.FIELDS.items() for n, v in enumerate(values)], "field string, ord int, value string")


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, JSON lines, or CSV with a header."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[kind](path)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Names the version that readers are to use; a version is a folder below root."""
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/active")


def active(spark: SparkSession, root: str) -> str:
    """The folder of the published version."""
    return f"{root}/{spark.read.schema('version string').json(f'{root}/active').first()[0]}"
