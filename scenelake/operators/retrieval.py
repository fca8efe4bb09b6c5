"""Retrieval: BM25, exact vector search, the tag filter, and the hybrid of filter and vectors.

Queries are a stated set, small beside the corpus, and are batched: one plan ranks all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions import rules
from scenelake.functions.text import tokens

K1, B = 1.5, 0.75
#: Queries that are sent out with one scan of the vectors.
BLOCK = 1024


def top(scored: DataFrame, k: int, best_first: bool = True, group: str = "qid", by: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best of each group with their rank; ties by key. Ranks are cut in every task before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(by) if best_first else F.asc(by), key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, dl: the inverted index, to be written partitioned by term."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("terms"))
    exploded = words.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return exploded.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def index_stats(docs: DataFrame) -> DataFrame:
    """n_docs, avgdl, n_terms, n_postings."""
    sizes = docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"))
    terms = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return sizes.join(terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings")))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score, rank. A term that a query repeats counts each time; documents without a term don't rank.

    Only the queries' terms leave the scan: texts are reduced to counts of those before anything is shuffled.
    """
    wanted = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("weight"))
    sized = docs.select("doc_id", tokens(F.col("text")).alias("terms")).select("doc_id", "terms", F.size("terms").alias("dl"))
    total = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = sized.select("doc_id", "dl", F.explode("terms").alias("term")).join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    counted = hits.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(total)).select(F.col("term").alias("term_"), "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = counted.join(F.broadcast(idf), F.col("term") == F.col("term_"))
    part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighed.select("term", "doc_id", part.alias("part")).join(F.broadcast(wanted), "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("part") * F.col("weight")), 6).alias("score"))
    return top(scored, k)


def padded(ranked: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Fills each query's ranking to k with documents of score 0, least ids first.

    The k least ids beyond those ranked are among the 2k least, so no query needs the whole corpus.
    """
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    spare = queries.select("qid").crossJoin(F.broadcast(first)).join(ranked.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    return top(ranked.select("qid", "doc_id", "score").unionByName(spare.withColumn("score", F.lit(0.0))), k)


def unit(vector: str = "embedding"):
    return F.transform(vector, lambda x: x.cast("double"))


def vector_search(vectors: DataFrame, queries: list[tuple], k: int = 10, block: int = BLOCK) -> DataFrame:
    """qid, doc_id, cosine, distance, rank for queries (qid, vector) against vectors (doc_id, embedding).

    Exact: every batch is one matrix product with a block of queries and keeps its own k best, so that only
    (batches x queries x k) rows are shuffled. distance is the squared Euclidean distance. Null vectors and those
    of another length or of length zero do not rank. Where the vectors have a column `allowed` (names of queries), a
    row ranks for those queries only.
    """
    spark, out = vectors.sparkSession, None
    kind = vectors.schema["doc_id"].dataType.simpleString()
    limited = ["allowed"] if "allowed" in vectors.columns else []
    for at in range(0, len(queries), block):
        ids = [q for q, _ in queries[at : at + block]]
        matrix = np.array([v for _, v in queries[at : at + block]], np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))  # block x dimensions numbers

        def search(batches, shared=shared):
            names, wanted = shared.value
            norms = np.linalg.norm(wanted, axis=1)
            for b in batches:
                column = b.column("embedding")
                keep = np.array([x is not None and len(x) == wanted.shape[1] for x in column.to_pylist()], bool)
                if not keep.any():
                    continue
                own = b.filter(pa.array(keep))
                m = np.array(own.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, wanted.shape[1])
                length = np.linalg.norm(m, axis=1)
                dot = m @ wanted.T
                cosine = np.where((length[:, None] > 0) & (norms > 0), dot / np.maximum(length[:, None] * norms, 1e-300), -np.inf)
                if limited:
                    fits = [set(x or ()) for x in own.column("allowed").to_pylist()]
                    cosine[~np.array([[q in x for q in names] for x in fits], bool)] = -np.inf
                distance = (length**2)[:, None] + norms**2 - 2 * dot
                keys = np.array(own.column("doc_id").to_pylist())
                for j, q in enumerate(names):
                    score = np.round(cosine[:, j], 6)
                    best = np.lexsort((keys, -score))[:k]
                    best = best[np.isfinite(score[best])]
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(best), pa.string()), own.column("doc_id").take(pa.array(best)), pa.array(score[best]), pa.array(np.round(np.maximum(distance[best, j], 0), 6))], names=["qid", "doc_id", "cosine", "distance"])

        part = vectors.select("doc_id", "embedding", *limited).mapInArrow(search, f"qid string, doc_id {kind}, cosine double, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"qid string, doc_id {kind}, cosine double, distance double, rank int")
    return top(out, k, by="cosine")


def hybrid_search(tags: DataFrame, vectors: DataFrame, queries: list[tuple], filters: dict[str, dict], k: int = 10) -> DataFrame:
    """qid, doc_id, cosine, rank for queries (qid, vector), those named in `filters` over clips with such tags only.

    One scan ranks all of them. A query whose filter fits no vector is ranked without it, as are those without a filter.
    """
    asked = [(q, v) for q, v in queries if filters.get(q)]
    every = vector_search(vectors, queries, k).select("qid", "doc_id", "cosine", "rank")
    if not asked:
        return every
    allowed = F.filter(F.array(*[F.when(rules.matches(filters[q]), F.lit(q)) for q, _ in asked]), lambda x: x.isNotNull())
    fitting = tags.select(F.col("clip_id").alias("doc_id"), allowed.alias("allowed")).where(F.size("allowed") > 0)
    found = vector_search(vectors.join(fitting, "doc_id").select("doc_id", "embedding", "allowed"), asked, k).select("qid", "doc_id", "cosine", "rank")
    return found.unionByName(every.join(found.select("qid").distinct(), "qid", "left_anti"))


def cosine_to(vector: list[float], column: str = "embedding"):
    """Cosine of unit vectors with a constant, as an expression, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return F.aggregate(F.zip_with(unit(column), q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def hybrid(tags: DataFrame, vectors: DataFrame, vector: list[float], wanted: dict | None, k: int = 10) -> DataFrame:
    """doc_id, cosine, rank, method, fallback: the tag filter, then exact cosine over what it leaves.

    Without a filter, or where nothing indexed fits it, all vectors are searched and rows say `embedding`. One plan:
    the unfiltered side is taken only if the filtered one is empty.
    """
    score = F.round(cosine_to(vector), 6).alias("cosine")
    fitting = tags.where(rules.matches(wanted) if wanted else F.lit(False)).select(F.col("clip_id").alias("doc_id"))
    filtered = vectors.join(fitting, "doc_id", "left_semi").select("doc_id", score).orderBy(F.desc("cosine"), "doc_id").limit(k)
    every = vectors.select("doc_id", score).orderBy(F.desc("cosine"), "doc_id").limit(k)
    found = filtered.agg((F.count("*") > 0).alias("found"))
    rows = filtered.select("doc_id", "cosine", F.lit("hybrid").alias("method"), F.lit(False).alias("fallback")).unionByName(
        every.join(F.broadcast(found.where("not found")), F.lit(True), "left_semi").select("doc_id", "cosine", F.lit("embedding").alias("method"), F.lit(True).alias("fallback"))
    )
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "doc_id")).cast("long"))


def hashing_encoder(texts: DataFrame, size: int = 64) -> DataFrame:
    """A stand-in encoder without a model: term counts hashed (28 bits of the MD5) to `size` places, scaled to length one.

    Texts without a term have no vector.
    """
    words = texts.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    place = F.pmod(F.conv(F.substring(F.md5("term"), 1, 7), 16, 10).cast("long"), F.lit(size)).cast("int")
    cells = words.groupBy("doc_id", place.alias("place")).agg(F.count("*").cast("double").alias("n"))
    packed = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return packed.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("length")).alias("embedding"))


def saved_bm25(spark, folder: str, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score, rank from the index in a folder (save_index); as bm25() over the texts it was made of."""
    index, total = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/totals")
    wanted = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("weight"))
    counted = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(total)).select(F.col("term").alias("term_"), "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = counted.join(idf, F.col("term") == F.col("term_")).select("term", "doc_id", part.alias("part")).join(wanted, "term")
    return top(scored.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("part") * F.col("weight")), 6).alias("score")), k)


def save_index(docs: DataFrame, folder: str) -> None:
    """Writes postings, clustered by term so that a search prunes row groups, and a one-row table of totals."""
    postings(docs).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/totals")
