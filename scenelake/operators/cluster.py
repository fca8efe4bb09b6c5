"""Projections and clusters of vectors: PCA, k-means, density clustering, magnitude, LSH."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.operators import spanning

#: Points of a cluster whose magnitude is taken, at most.
PER_CLUSTER = 200


def pca(points: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """id, x projected to k numbers, and the share of variance of each. The covariance is summed in one pass.

    Signs are fixed: the largest weight of every direction is positive.
    """
    width = len(points.select("x").first().x)

    def moments(batches):
        n, total, square = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            m = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            n, total, square = n + len(m), total + m.sum(axis=0), square + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], names=["n", "total", "square"])

    parts = points.select("x").mapInArrow(moments, "n double, total array<double>, square array<double>")
    n, total, square = 0.0, np.zeros(width), np.zeros((width, width))
    for r in parts.toLocalIterator():  # one small row a partition
        n, total, square = n + r.n, total + np.array(r.total), square + np.array(r.square).reshape(width, width)
    mean = total / n
    values, directions = np.linalg.eigh(square / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1][:k]
    basis = directions[:, order]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    shared = points.sparkSession.sparkContext.broadcast((mean, basis))

    def project(batches):
        mean, basis = shared.value
        for b in batches:
            m = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, len(mean))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list((m - mean) @ basis), pa.list_(pa.float64()))], names=["id", "x"])

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "x").mapInArrow(project, f"id {kind}, x array<double>"), (values[order] / values.sum()).tolist()


def kmeans(points: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """id, x, cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("v_", array_to_vector("x"))
    return KMeans(k=k, seed=seed, featuresCol="v_", predictionCol="cluster").fit(rows).transform(rows).drop("v_")


def density_labels(x: np.ndarray, min_size: int = 50, min_samples: int = 10) -> np.ndarray:
    """Hierarchical density clustering (Campello et al. 2013) of points in memory: labels from 0, -1 for noise.

    Core distances give mutual reachabilities, of which a minimum spanning tree is made and condensed.
    """
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    d = spanning.distances(x, x)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    best, parent, inside = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0], edges = True, []
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[j], parent[j], j))
        inside[j] = True
        closer = reach[j] < best
        best[closer], parent[closer] = reach[j][closer], j
    return condense(n, edges, min_size)


def condense(n: int, edges: list[tuple[float, int, int]], min_size: int) -> np.ndarray:
    """Labels of n points from the edges of their spanning tree.

    Cut from the longest edge, the tree is condensed to clusters of at least min_size, of which the most stable that
    do not overlap are taken.
    """
    # single linkage: edges of equal length join all their sides at once, so that any least tree gives the same nodes
    tree: list[tuple[list[int], float]] = []
    size, first = [1] * n, list(range(n))
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for w, alike in itertools.groupby(sorted(edges), key=lambda e: e[0]):
        sides: dict[int, list[int]] = {}
        for _, a, b in alike:
            a, b = find(a), find(b)
            root[a] = b
            sides[b] = sides.pop(b, [b]) + sides.pop(a, [a])
        for a, joined in sides.items():
            joined.sort(key=first.__getitem__)
            tree.append((joined, w))
            size.append(sum(size[s] for s in joined))
            first.append(first[joined[0]])
            root.append(len(root))
            root[a] = len(root) - 1
    # condense: walk down; a split with two or more large sides starts clusters
    members: list[list[int]] = [[]]
    born, children, held = [0.0], [[]], [0.0]
    stack = [(len(size) - 1, 0)]

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            a = todo.pop()
            if a < n:
                out.append(a)
            else:
                todo += tree[a - n][0]
        return out

    while stack:
        node, c = stack.pop()
        if node < n:
            members[c].append(node)
            continue
        parts, w = tree[node - n]
        lam = 1 / max(w, 1e-12)
        big = [s for s in parts if size[s] >= min_size]
        leaving = [s for s in parts if size[s] < min_size]
        if len(big) == 1:
            stack.append((big[0], c))
            held[c] += (lam - born[c]) * sum(size[s] for s in leaving)
        else:
            held[c] += (lam - born[c]) * size[node]
            for s in big:
                members.append([])
                born.append(lam)
                children.append([])
                held.append(0.0)
                children[c].append(len(members) - 1)
                stack.append((s, len(members) - 1))
        for s in leaving:
            members[c] += points(s)
    chosen = [True] * len(members)
    total = held[:]
    for c in range(len(members) - 1, -1, -1):
        below = sum(total[k] for k in children[c])
        if children[c] and (below > held[c] or c == 0):
            chosen[c], total[c] = False, below
    labels = np.full(n, -1)
    number = 0
    todo = [(0, False)]
    while todo:
        c, under = todo.pop()
        take = chosen[c] and not under and c != 0
        if take:
            inner, all_members = [c], []
            while inner:
                k = inner.pop()
                all_members += members[k]
                inner += children[k]
            labels[all_members] = number
            number += 1
        todo += [(k, under or take) for k in children[c]]
    return labels


def density_clusters(points: DataFrame, min_size: int = 50, min_samples: int = 10, block: int = spanning.BLOCK) -> DataFrame:
    """id, cluster: all points are clustered by density, none is sampled; -1 is noise.

    A point without coordinates is noise, and so is everything where there are fewer than min_size points. Repeated rows
    are points of their own. Only the edges of the tree come together in one task,
    which condenses them; its memory grows with the points.
    """
    nodes = spanning.numbered(points)
    tree = spanning.spanning_tree(nodes, min_samples, block)

    def labels(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pdf[["lo", "hi"]].to_numpy(np.int64)
        node, at = np.unique(ends, return_inverse=True)
        at = at.reshape(-1, 2)
        found = condense(len(node), list(zip(pdf["w"].tolist(), at[:, 0].tolist(), at[:, 1].tolist(), strict=True)), min_size) if len(node) >= min_size else np.full(len(node), -1)
        return pd.DataFrame({"at": node, "found": found.astype(np.int32)})

    found = tree.withColumn("tree", F.lit(0)).groupBy("tree").applyInPandas(labels, "at long, found int")
    clustered = nodes.join(found, F.col("node") == F.col("at"), "left").select("id", F.coalesce("found", F.lit(-1)).alias("cluster"))
    return clustered.unionByName(points.where(F.col("x").isNull() | F.exists("x", lambda v: v.isNull())).select("id", F.lit(-1).alias("cluster")))


def magnitude(x: np.ndarray, t: float = 1.0) -> tuple[float, np.ndarray]:
    """Sum of the weights w with Z w = 1, Z = exp(-t d), and the weights; a singular matrix gives n and ones."""
    square = (x**2).sum(axis=1)
    z = np.exp(-t * np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0)))
    try:
        w = np.linalg.solve(z, np.ones(len(x)))
    except np.linalg.LinAlgError:
        return float(len(x)), np.ones(len(x))
    return float(w.sum()), w


def cluster_profile(points: DataFrame, key: str = "cluster", per_cluster: int = PER_CLUSTER) -> DataFrame:
    """cluster, size, magnitude, mag_per_clip, clip_ids_sample, from at most per_cluster points of each; noise (-1) is left out."""
    order = Window.partitionBy(key).orderBy(F.xxhash64("id"), "id")
    kept = points.where(F.col(key) >= 0)
    sizes = kept.groupBy(key).agg(F.count("*").alias("size"))
    drawn = kept.select("id", "x", key).withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= per_cluster)

    def profile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        total, _ = magnitude(np.array(pdf["x"].tolist(), np.float64))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "magnitude": [round(total, 4)], "mag_per_clip": [round(total / len(pdf), 4)], "clip_ids_sample": [pdf["id"].astype(str).tolist()[:10]]})

    out = drawn.groupBy(key).applyInPandas(profile, f"{key} int, magnitude double, mag_per_clip double, clip_ids_sample array<string>")
    return sizes.join(out, key)


def lsh_search(points: DataFrame, vector: list[float], k: int = 10, seed: int = 42) -> DataFrame:
    """id, distance: approximate nearest neighbours by random projections, many tables of wide buckets."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = points.select("id", array_to_vector("x").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=12, seed=seed).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense(vector), k, "distance").select("id", F.round("distance", 6).alias("distance"))


def standardise(points: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; constant columns become 0."""
    stats = points.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scaled = lambda c: F.when(F.col(f"s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c)
    return points.join(F.broadcast(stats)).select(*[scaled(c) if c in columns else F.col(c) for c in points.columns])
