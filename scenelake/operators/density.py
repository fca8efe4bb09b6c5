"""Densities of points and the rare clips they reveal.

A kernel density is fitted on all points, which are sent to every task in blocks of BLOCK, and every row is scored
by matrix products whose kernel sums add up over the blocks; Gaussian models are aggregates.

In one and two dimensions the plane is cut into cells of SIDE bandwidths. The points of a cell with CROWD or more go
into its moments: the kernel, as a function of the fitted point, is interpolated at ORDER Chebyshev nodes a side,
which gives it to the last digits of a double, and the sum over the cell becomes a sum over nodes. So work grows with the
points, not with their square. Points of emptier cells are summed one by one. Rows whose sum is so small that the
moments' rounding could show are scored once more by all points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions import rules
from scenelake.functions import taxonomy as T

#: Fitted points in one broadcast.
BLOCK = 20_000
BANDWIDTH_2D = 0.3
EPSILON = 1e-6
#: Bandwidths along a cell, nodes along it, points that make moments of a cell, and the least share of all points in a
#: row's kernel sum (each counts 1 at its own place) that is taken from moments.
SIDE, ORDER, CROWD, LEAST = 4.0, 32, 4096, 1e-5


def kde(points: DataFrame, fit: DataFrame, bandwidth: float | None = None, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """id, log_density of points (id, x) under a Gaussian kernel density on fit (id, x).

    Without a bandwidth it is n^(-1/(d+4)). Points with a null coordinate have no density; without points to fit on
    there is none either.
    """
    known = fit.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    count, d = known.agg(F.count("*"), F.max(F.size("x"))).first()
    if not count:
        return points.select("id", F.lit(None).cast("double").alias("log_density"))
    h = bandwidth or count ** (-1 / (d + 4))
    norm = math.log(count) + 0.5 * d * math.log(2 * math.pi * h * h)
    if d > 2:
        return _scored(points, _sent(known, block), {}, d, h, norm).select("id", "log_density")
    cell = F.concat_ws(",", *[F.floor(F.col("x")[i].cast("double") / (SIDE * h)).cast("string") for i in range(d)])
    named = known.select("id", "x", cell.alias("cell"))
    full = named.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= crowd).select(F.col("cell").alias("cell_"))  # a cell for `crowd` points
    moments = {}
    for r in named.join(full, F.col("cell") == F.col("cell_")).mapInArrow(_moments(d, h), "cell string, moments binary").toLocalIterator():
        place = tuple(int(v) for v in r.cell.split(","))
        moments[place] = moments.get(place, 0) + np.frombuffer(r.moments, np.float64).reshape([ORDER] * d)
    if not moments:
        return _scored(points, _sent(known, block), {}, d, h, norm).select("id", "log_density")
    emptier = named.join(full, F.col("cell") == F.col("cell_"), "left_anti")
    out = _scored(points, _sent(emptier, block), moments, d, h, norm)
    sure = F.col("log_density") >= math.log(LEAST * count) - norm
    unsure = out.where(~sure).select("id", "x")
    if unsure.isEmpty():
        return out.select("id", "log_density")
    return out.where(F.col("log_density").isNull() | sure).select("id", "log_density").union(_scored(unsure, _sent(known, block), {}, d, h, norm).select("id", "log_density"))


def _sent(fit: DataFrame, block: int) -> list:
    """The points in blocks that every task can read."""
    rows, shared, part = fit.orderBy(F.xxhash64("id"), "id").select("x"), [], []
    for r in rows.toLocalIterator():
        part.append(r.x)
        if len(part) == block:
            shared.append(fit.sparkSession.sparkContext.broadcast(np.array(part, np.float64)))  # block x d numbers
            part = []
    if part:
        shared.append(fit.sparkSession.sparkContext.broadcast(np.array(part, np.float64)))
    return shared


def _nodes() -> np.ndarray:
    return np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))


def _basis(u: np.ndarray) -> np.ndarray:
    """The Lagrange polynomials of the nodes at places u of -1 to 1: the sum of Chebyshev polynomials that are 1 at a node and 0 at the others."""
    k = np.arange(ORDER)
    at_nodes = np.cos(np.outer(k, np.arccos(_nodes()))) * np.where(k > 0, 2.0, 1.0)[:, None] / ORDER
    return np.cos(np.arccos(np.clip(u, -1, 1))[:, None] * k) @ at_nodes


def _moments(d: int, h: float):
    def add(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(b.num_rows, d)
            cells = np.array(b.column("cell").to_pylist(), object)
            for c in set(cells):
                u = [2 * (x[cells == c, i] / (SIDE * h) - int(v)) - 1 for i, v in enumerate(c.split(","))]
                sides = [_basis(v) for v in u]
                found[c] = found.get(c, 0) + (sides[0].sum(axis=0) if d == 1 else sides[0].T @ sides[1])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([m.tobytes() for m in found.values()], pa.binary())], names=["cell", "moments"])

    return add


def _scored(points: DataFrame, shared: list, moments: dict, d: int, h: float, norm: float) -> DataFrame:
    """id, x, log_density: kernel sums over blocks of points and over the moments of cells."""
    kind = points.schema["id"].dataType.simpleString()
    cells = points.sparkSession.sparkContext.broadcast(sorted(moments.items()))

    def score(batches):
        for b in batches:
            rows = b.column("x").to_pylist()
            out: list = [None] * len(rows)
            known = [i for i, r in enumerate(rows) if r is not None and None not in r]
            m = np.array([rows[i] for i in known], np.float64).reshape(len(known), d)
            total = np.zeros(len(known))
            for place, moment in cells.value:
                kernels = [np.exp(-((m[:, i, None] - SIDE * h * (c + (_nodes() + 1) / 2)) ** 2) / (2 * h * h)) for i, c in enumerate(place)]
                total += kernels[0] @ moment if d == 1 else ((kernels[0] @ moment) * kernels[1]).sum(axis=1)
            with np.errstate(divide="ignore"):
                logs = np.log(np.maximum(total, 0))
            for fitted in (x.value for x in shared):
                squares = (fitted**2).sum(axis=1)
                for at in range(0, len(known), 256):
                    own = m[at : at + 256]
                    e = -np.maximum((own**2).sum(axis=1)[:, None] + squares - 2 * own @ fitted.T, 0) / (2 * h * h)
                    most = e.max(axis=1, keepdims=True)
                    logs[at : at + 256] = np.logaddexp(logs[at : at + 256], most[:, 0] + np.log(np.exp(e - most).sum(axis=1)))
            for i, v in zip(known, (logs - norm).tolist(), strict=True):
                out[i] = v
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(out, pa.float64())], names=["id", "x", "log_density"])

    x = points.select("id", F.col("x").cast("array<double>").alias("x"))
    return x.mapInArrow(score, f"id {kind}, x array<double>, log_density double")


def long_tail(densities: DataFrame, share: float = 0.05, column: str = "density") -> DataFrame:
    """Rows strictly below the percentile of their densities; ties at it stay out."""
    limit = densities.agg(F.percentile(column, share).alias("limit_"))
    return densities.join(F.broadcast(limit), F.col(column) < F.col("limit_")).drop("limit_")


def numbers_vector() -> Column:
    return F.array(*T.DIMENSIONS)


def gaussian(rows: DataFrame, columns: list[str], group: str | None = None, least: int = 5) -> DataFrame:
    """Mean and population deviation (+1e-6) of each column, for each group; groups of fewer than `least` rows take those of all rows."""
    stats = lambda p: [F.avg(c).alias(f"{p}mu_{c}") for c in columns] + [(F.stddev_pop(c) + EPSILON).alias(f"{p}sd_{c}") for c in columns]
    every = rows.agg(*stats("g_"))
    if group is None:
        return every.toDF(*[c.removeprefix("g_") for c in every.columns])
    own = rows.groupBy(group).agg(F.count("*").alias("n"), *stats("")).join(F.broadcast(every))
    pick = lambda c: F.when(F.col("n") < least, F.col(f"g_{c}")).otherwise(F.col(c)).alias(c)
    return own.select(group, "n", *[pick(f"{s}_{c}") for s in ("mu", "sd") for c in columns])


def diagonal_log_density(columns: list[str]) -> Column:
    """Log density under the diagonal Gaussian whose parameters stand in mu_ and sd_ columns of the row."""
    out = F.lit(-0.5 * len(columns) * math.log(2 * math.pi))
    for c in columns:
        z = (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")
        out = out - F.log(f"sd_{c}") - 0.5 * z * z
    return out


def nearest(rows: DataFrame, centers: DataFrame, columns: list[str], key: str, group: str) -> DataFrame:
    """Each row with the parameters of its nearest center (plain distance, ties to the least group); centers are few and sent out."""
    packed = centers.select(F.struct(group, *[c for c in centers.columns if c != group]).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("centers"))
    # centers stand in an array, so a row is compared with all of them without being multiplied
    distance = lambda c: sum(((F.col(x) - c[f"mu_{x}"]) * (F.col(x) - c[f"mu_{x}"]) for x in columns), F.lit(0.0))
    measured = rows.join(F.broadcast(packed)).withColumn("best", F.array_min(F.transform("centers", lambda c: F.struct(distance(c).alias("d"), c[group].alias(group), c.alias("c")))))
    return measured.select(*rows.columns, F.col(f"best.{group}").alias(f"nearest_{group}"), F.col("best.d").alias("squared_distance"), *[F.col(f"best.c.{c}").alias(c) for c in centers.columns if c != group])


def semantic_gaps(rows: DataFrame, centers: DataFrame, columns: list[str], key: str, group: str, names: DataFrame | None = None, n: int = 200) -> DataFrame:
    """rank, key, log_density, nearest cluster, its name, the original cluster and whether that is noise (-1): the n least dense."""
    scored = nearest(rows, centers, columns, key, group).withColumn("log_density", F.round(diagonal_log_density(columns), 6))
    lowest = scored.select(key, group, f"nearest_{group}", "log_density").orderBy("log_density", key).limit(n)
    ranked = lowest.withColumn("rank", F.row_number().over(Window.orderBy("log_density", key)).cast("long"))
    default = F.concat(F.lit("cluster_"), F.col(f"nearest_{group}").cast("string"))
    if names is None:
        named = ranked.withColumn("scenario_name", default)
    else:
        label = names.select(F.col(group).alias("g_"), F.col("label").alias("label_"))
        named = ranked.join(F.broadcast(label), F.col(f"nearest_{group}") == F.col("g_"), "left").withColumn("scenario_name", F.coalesce(F.when(F.col("label_") != "", F.col("label_")), default))
    return named.select("rank", key, "log_density", F.col(f"nearest_{group}").alias("nearest_cluster"), "scenario_name", F.col(group).alias("original_cluster"), (F.col(group) == -1).alias("is_noise"))


def gap_scores(numbers: DataFrame, threshold: float = 0.7, n: int = 200) -> DataFrame:
    """rank, clip_id, gap_score, log_density and the seven numbers of the rarest clips of high hazard.

    The density is the diagonal Gaussian over all fully observed clips; only those at or above the threshold are scored.
    """
    known = numbers.dropna(subset=T.DIMENSIONS)
    risky = known.where(F.col("hazard_proximity") >= threshold).join(F.broadcast(gaussian(known, T.DIMENSIONS)))
    scored = risky.withColumn("log_density", F.round(diagonal_log_density(T.DIMENSIONS), 6))
    scored = scored.withColumn("gap_score", F.round(-F.col("log_density") * F.col("hazard_proximity") * rules.frequency_weight(), 4))
    best = scored.orderBy(F.desc("gap_score"), "clip_id").limit(n)
    return best.select(F.row_number().over(Window.orderBy(F.desc("gap_score"), "clip_id")).cast("long").alias("rank"), "clip_id", "gap_score", "log_density", *[F.round(d, 3).alias(d) for d in T.DIMENSIONS])


def region_mean(gaps: DataFrame, n: int = 20) -> DataFrame:
    means = gaps.where(F.col("rank") <= n).agg(*[F.round(F.avg(d), 3).alias(d) for d in T.DIMENSIONS])
    return means.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("mean")) for d in T.DIMENSIONS])).alias("x")).select("x.*")


def scenario_counts(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("scenario_name").agg(F.count("*").alias("n"), F.count_if("is_noise").alias("n_noise"), F.count_if(~F.col("is_noise")).alias("n_edge"))


def mixture(points: DataFrame, fit: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """id, log_density under a Gaussian mixture with full covariances; it takes the place of a trained flow."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    model = GaussianMixture(k=k, seed=seed, featuresCol="v").fit(fit.select(array_to_vector("x").alias("v")))
    parts = [(w, np.array(r["mean"].toArray()), r["cov"].toArray()) for w, r in zip(model.weights, model.gaussiansDF.collect(), strict=True)]
    shared = points.sparkSession.sparkContext.broadcast([(math.log(max(w, 1e-300)), m, np.linalg.inv(c + EPSILON * np.eye(len(m))), np.linalg.slogdet(c + EPSILON * np.eye(len(m)))[1]) for w, m, c in parts])
    kind = points.schema["id"].dataType.simpleString()

    def score(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64)
            if not len(x):
                continue
            terms = np.stack([w - 0.5 * (x.shape[1] * math.log(2 * math.pi) + det + np.einsum("ni,ij,nj->n", x - m, inv, x - m)) for w, m, inv, det in shared.value])
            most = terms.max(axis=0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(most + np.log(np.exp(terms - most).sum(axis=0)))], names=["id", "log_density"])

    return points.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())).select("id", "x").mapInArrow(score, f"id {kind}, log_density double")
