"""The minimum spanning tree of mutual reachability over all points, the ground of density clustering.

Points of equal coordinates are one node with a count; each copy hangs on it by an edge of its core distance, the least
that a copy can have. Space is cut into blocks of at most about BLOCK nodes, by the medians of some; every node is in one.
A task compares one block with FAN others, so no task, broadcast or driver holds all points and none is left out.

Inside a task blocks are cut on into boxes of LEAF nodes. A box is compared with others from the nearest on, and not with
those farther than what its nodes have found: the k-th neighbour, or the least edge out of their part. A product of single
precision, with a margin above its error, tells what may be near enough; that is measured in double precision. Squares of
differences are added coordinate by coordinate, so that a distance is the same number from either end, and edges are
ordered by (weight, lesser node, greater node): no two are equal and Boruvka's rounds make no cycle. What boxes save depends
on the points; in the worst case all pairs are compared.

That is once, for the core distances. The same pass lists the NEAREST nodes of each. An edge that is in no list is longer than
its nodes' lists reach, so a part whose least listed edge is shorter than that for all its nodes has its least edge. In each
round only nodes that leave it open are compared with all others; the largest part waits if another has an edge, as any
parts' least edges belong to the tree.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.sources import tables

#: Nodes of a block at most, blocks that one task compares a block with, nodes of a box.
BLOCK, FAN, LEAF = 65_536, 4, 128
#: Nodes that are listed as the nearest of each, itself among them.
NEAREST = 16
#: Blocks that there are at least, if they have LEAST nodes; nodes for each block by which space is cut.
SPREAD, LEAST, DRAWN = 12, 4096, 64


def _cut(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: unlike a checkpoint, a table hands on no constraints that multiply from round to round."""
    folder = f"{tables.shared_folder(rows.sparkSession)}/spanning-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def numbered(points: DataFrame) -> DataFrame:
    """node, id, x of points with coordinates; nodes are numbered in the order of id."""
    known = points.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    ordered = known.select("id", F.col("x").cast("array<double>").alias("x")).orderBy("id", "x")
    return _cut(ordered.withColumn("node", F.monotonically_increasing_id()))


def _cuts(drawn: np.ndarray, most: int) -> tuple | None:
    """(dimension, value, at most, above) by the median of the widest dimension, until no side has more than most."""
    if len(drawn) <= most:
        return None
    at = int(np.ptp(drawn, axis=0).argmax())
    values = np.sort(drawn[:, at])
    if values[0] == values[-1]:
        return None
    value = values[(len(values) - 1) // 2]
    if value == values[-1]:
        value = values[np.searchsorted(values, value) - 1]
    low = drawn[:, at] <= value
    return at, float(value), _cuts(drawn[low], most), _cuts(drawn[~low], most)


def _leaves(cuts: tuple | None) -> int:
    return 1 if cuts is None else _leaves(cuts[2]) + _leaves(cuts[3])


def _side(x: np.ndarray, cuts: tuple | None) -> np.ndarray:
    """The number of the leaf that each point falls to."""
    if cuts is None:
        return np.zeros(len(x), np.int32)
    low, out = x[:, cuts[0]] <= cuts[1], np.zeros(len(x), np.int32)
    out[low], out[~low] = _side(x[low], cuts[2]), _leaves(cuts[2]) + _side(x[~low], cuts[3])
    return out


def _boxed(x: np.ndarray) -> np.ndarray:
    """An order in which each LEAF points are a box of a k-d tree."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        half = (math.ceil(len(own) / LEAF) + 1) // 2 * LEAF
        own = own[np.argpartition(x[own, int(np.ptp(x[own], axis=0).argmax())], half - 1)]
        todo += [own[half:], own[:half]]
    return np.concatenate(out)


def _placed(points: DataFrame, block: int) -> tuple[DataFrame, int]:
    """node, x, times, block, pos: space is cut into that many blocks, whose nodes are in the order of boxes."""
    m = points.count()
    drawn = points.orderBy(F.xxhash64("node"), "node").limit(DRAWN * max(SPREAD, math.ceil(m / block))).select("x").toPandas()
    size = min(block, max(LEAST, math.ceil(m / SPREAD)))
    cuts = _cuts(np.array(drawn["x"].tolist(), np.float64), max(1, len(drawn) * size // m))

    def side(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(block=_side(np.array(pdf["x"].tolist(), np.float64), cuts))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        pos = np.empty(len(pdf), np.int32)
        pos[_boxed(np.array(pdf["x"].tolist(), np.float64))] = np.arange(len(pdf), dtype=np.int32)
        return pdf.assign(pos=pos)

    schema = "node long, x array<double>, times long, block int"
    return points.select("node", "x", "times").mapInPandas(side, schema).groupBy("block").applyInPandas(order, f"{schema}, pos int"), _leaves(cuts)


_KINDS = {"node": np.int64, "times": np.int64, "core": np.float64, "part": np.int64, "bound": np.float64}


def _packed(rows: DataFrame) -> DataFrame:
    """One row a block: nodes in the order of boxes, coordinates, copies, core distances and parts as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = np.array(pdf["x"].tolist(), np.float64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "x": [x.tobytes()]} | {c: [pdf[c].to_numpy(kind).tobytes()] for c, kind in _KINDS.items()})

    return rows.groupBy("block").applyInPandas(pack, "block int, x binary, node binary, times binary, core binary, part binary, bound binary")


def _compared(mine: DataFrame, heads: int, blocks: DataFrame, count: int, fan: int, work, schema: str) -> DataFrame:
    """work(own block, rows of others) for each of mine, of which there are heads, and every fan of blocks."""
    columns = ["x", *_KINDS]
    own = mine.select(F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit((count - 1) // fan))).alias("g"), F.lit(-1).alias("j"), *columns)
    others = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("i"), F.floor(F.col("block") / fan).cast("int").alias("g"), F.col("block").alias("j"), *columns)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        own, others = pdf[pdf["j"] < 0], pdf[pdf["j"] >= 0]
        if own.empty or others.empty:  # a block number that no point fell to
            return pd.DataFrame()
        return work(_Boxes(own), others)

    spread = min(4096, 2 * heads * math.ceil(count / fan))  # named, so that tasks of little data but much work are not joined
    return own.unionByName(others).repartition(spread, "i", "g").groupBy("i", "g").applyInPandas(task, schema)


class _Boxes:
    """Blocks one after the other, and the bounds of their boxes."""

    def __init__(self, rows: pd.DataFrame):
        self.i = rows["i"].iloc[0]
        for c, kind in _KINDS.items():
            setattr(self, c, np.concatenate([np.frombuffer(v, kind) for v in rows[c]]))
        sizes = [len(v) // 8 for v in rows["node"]]
        self.x = np.concatenate([np.frombuffer(v, np.float64).reshape(n, -1) for v, n in zip(rows["x"], sizes, strict=True)])
        self.start = np.concatenate([np.arange(0, n, LEAF) + at for n, at in zip(sizes, np.cumsum([0, *sizes]), strict=False)])
        self.end = np.append(self.start[1:], len(self.x))
        self.low, self.high = np.minimum.reduceat(self.x, self.start), np.maximum.reduceat(self.x, self.start)
        self.core_low = np.minimum.reduceat(self.core, self.start)
        self.part_low, self.part_high = np.minimum.reduceat(self.part, self.start), np.maximum.reduceat(self.part, self.start)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """No point of a box is nearer to any of x, but for the last digits."""
        return np.sqrt((np.maximum(0, np.maximum(self.low - x.max(axis=0), x.min(axis=0) - self.high)) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, the same bits from either side."""
    out = np.zeros((len(a), len(b)))
    for p, q in zip(a.T, b.T, strict=True):
        out += (p[:, None] - q) ** 2
    return np.sqrt(out)


def _within(a: np.ndarray, b: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, c, d: what is at most limit[r] apart; where that is infinite, the k nearest at least (all for k = 0)."""
    middle = a.mean(axis=0)
    p, q = a - middle, b - middle
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    scale = pp.max() + qq.max()
    kind, unit = (np.float32, 2.0**-22) if 1e-25 < scale < 1e25 else (np.float64, 2.0**-50)
    margin = (a.shape[1] + 4) * unit * scale
    near = np.hstack([-2 * p, pp[:, None], np.ones((len(p), 1))]).astype(kind) @ np.hstack([q, np.ones((len(q), 1)), qq[:, None]]).astype(kind).T
    bound = np.maximum(limit, 0) ** 2
    if k and len(b) > k and not np.isfinite(bound).all():
        far = ~np.isfinite(bound)
        bound[far] = np.partition(near[far], k - 1, axis=1)[:, k - 1] + margin
    found = np.flatnonzero(~(near > (bound + margin).astype(kind)[:, None]))
    r, c = found // len(b), found % len(b)
    d = np.zeros(len(r))
    for u, v in zip(a.T, b.T, strict=True):
        d += (u[r] - v[c]) ** 2
    d = np.sqrt(d)
    close = d <= limit[r]
    return r[close], c[close], d[close]


def _sweep(x: np.ndarray, limit: np.ndarray, other: _Boxes, gap: np.ndarray, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """r, c, d of x and the other's points, nearest boxes first, within limit, which the caller lowers between the steps."""
    order = np.argsort(gap, kind="stable")
    order = order[: np.searchsorted(gap[order], np.inf)]
    at = 0
    while at < len(order):
        end = at + (64 if np.isfinite(limit).all() else 8)
        end = min(end, int(np.searchsorted(gap[order], limit.max() * (1 + 1e-9), "right")))
        if end <= at:
            return
        columns = np.concatenate([np.arange(other.start[b], other.end[b]) for b in order[at:end]])
        r, c, d = _within(x, other.x[columns], limit, k)
        yield r, columns[c], d
        at = end


def _least(best: np.ndarray, of: np.ndarray, r: np.ndarray, d: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of each row of best and of the distances d that it was given, and to what they lead."""
    k = best.shape[1]
    order = np.lexsort((c, d, r))
    r, d, c = r[order], d[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    more, to = np.full(best.shape, np.inf), np.full(best.shape, -1)
    more[r[rank < k], rank[rank < k]], to[r[rank < k], rank[rank < k]] = d[rank < k], c[rank < k]
    return _first(np.concatenate([best, more], axis=1), np.concatenate([of, to], axis=1), k)


def _first(d: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(of, order, axis=1)


def _nearest(blocks: DataFrame, count: int, fan: int, k: int, listed: int) -> DataFrame:
    """node, core, floor, near: the distance to its k-th nearest, itself the nearest and copies counted; the distance of the last listed; the listed nodes, each with its distance."""

    def near(own: _Boxes, rows: pd.DataFrame) -> pd.DataFrame:
        inside, rows = bool((rows["j"] == own.i).any()), rows[rows["j"] != own.i]
        others = _Boxes(rows) if len(rows) else None
        out = []
        for start, end in zip(own.start, own.end, strict=True):
            x = own.x[start:end]
            none = np.full((len(x), listed), np.inf), np.full((len(x), listed), -1)
            here, there, limit = none, none, np.full(len(x), np.inf)
            for r, c, d in _sweep(x, limit, own, own.gaps(x), listed):
                here = _least(*here, r, d, c)
                limit[:] = here[0][:, -1]
            if others is not None:
                for r, c, d in _sweep(x, limit, others, others.gaps(x), listed):
                    there = _least(*there, r, d, c)
                    limit[:] = np.sort(np.concatenate([here[0], there[0]], axis=1), axis=1)[:, listed - 1]
            found = [(d, np.where(of < 0, -1, b.node[of]), np.where(of < 0, 0, b.times[of])) for b, (d, of) in ((own, here), (others, there)) if b is not None and (b is others or inside)]
            out.append([np.concatenate(v, axis=1) for v in zip(*found, strict=True)] if found else [none[0], none[1], none[1]])
        width = max(v[0].shape[1] for v in out)
        parts = [np.concatenate([v[c] for v in out]).tobytes() for c in range(3)]
        return pd.DataFrame({"i": [own.i], "node": [own.node.tobytes()], "width": [width], "d": [parts[0]], "to": [parts[1]], "times": [parts[2]]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.concatenate([np.frombuffer(b, kind).reshape(-1, w) for b, w in zip(pdf[c], pdf["width"], strict=True)], axis=1)
        d, to, times = read("d", np.float64), read("to", np.int64), read("times", np.int64)
        order = np.argsort(d, axis=1, kind="stable")[:, :listed]
        d, to, times = (np.take_along_axis(v, order, axis=1) for v in (d, to, times))
        core = np.take_along_axis(d, (np.cumsum(times, axis=1) >= k).argmax(axis=1)[:, None], axis=1)[:, 0]
        node = np.frombuffer(pdf["node"].iloc[0], np.int64)
        real = (to >= 0) & (to != node[:, None])
        near = [[{"to": b, "d": a} for a, b in zip(u[v].tolist(), t[v].tolist(), strict=True)] for u, t, v in zip(d, to, real, strict=True)]
        return pd.DataFrame({"node": node, "core": core, "floor": np.maximum(core, d[:, -1]), "near": near})

    found = _compared(blocks, count, blocks, count, fan, near, "i int, node binary, width int, d binary, to binary, times binary")
    return found.groupBy("i").applyInPandas(merge, "node long, core double, floor double, near array<struct<to:long,d:double>>")


def _outward(own: _Boxes, other: _Boxes) -> pd.DataFrame:
    """For each part with open nodes in the block the least edge to another part, if these others hold one."""
    parts, of = np.unique(own.part, return_inverse=True)
    w, lo, hi, to = np.full(len(parts), np.inf), *(np.zeros(len(parts), np.int64) for _ in range(3))
    np.minimum.at(w, of, own.bound)  # the least listed: what is longer is not wanted
    lo[:] = np.iinfo(np.int64).max
    for start, end in zip(own.start, own.end, strict=True):
        rows = np.arange(start, end)[own.core[start:end] <= w[of[start:end]]]
        if not len(rows):
            continue
        x, part = own.x[rows], own.part[rows]
        gap = np.maximum(other.gaps(x), other.core_low)
        gap[(other.part_low == part.min()) & (other.part_high == part.max()) & (part.min() == part.max())] = np.inf
        limit = w[of[rows]]
        for r, c, d in _sweep(x, limit, other, gap):
            apart = np.flatnonzero(part[r] != other.part[c])
            r, c = r[apart], c[apart]
            reach = np.maximum(d[apart], np.maximum(own.core[rows[r]], other.core[c]))
            good = np.flatnonzero(reach <= limit[r])
            r, c, reach = r[good], c[good], reach[good]
            p, a, b = of[rows[r]], own.node[rows[r]], other.node[c]
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((high, low, reach, p))
            order = order[np.flatnonzero(np.diff(p[order], prepend=-1))]
            p, reach, low, high, c = p[order], reach[order], low[order], high[order], c[order]
            better = (reach < w[p]) | ((reach == w[p]) & ((low < lo[p]) | ((low == lo[p]) & (high < hi[p]))))
            p = p[better]
            w[p], lo[p], hi[p], to[p] = reach[better], low[better], high[better], other.part[c[better]]
            limit[:] = np.where(own.core[rows] <= w[of[rows]], w[of[rows]], -1)
    return pd.DataFrame({"part": parts, "w": w, "lo": lo, "hi": hi, "to": to})[lo < np.iinfo(np.int64).max]


def _merged(chosen: DataFrame) -> DataFrame:
    """part, parent: parts that chosen edges connect share a parent. Of two that chose each other the lesser is the root; one that only was chosen is its own."""
    back = chosen.select(F.col("part").alias("at"), F.col("to").alias("next"))
    root = (F.col("next") == F.col("part")) & (F.col("part") < F.col("to"))
    waiting = chosen.select(F.col("to").alias("part")).distinct().join(chosen.select("part"), "part", "left_anti").select("part", F.col("part").alias("parent"))
    parents = _cut(waiting.union(chosen.join(back, F.col("to") == F.col("at"), "left").select("part", F.when(root, F.col("part")).otherwise(F.col("to")).alias("parent"))))
    while True:  # each round halves the way to the root
        up = parents.select(F.col("part").alias("at"), F.col("parent").alias("above"))
        jumped = _cut(parents.join(up, F.col("parent") == F.col("at")).select("part", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        if jumped.where("moved").isEmpty():
            return jumped.select("part", "parent")
        parents = jumped.select("part", "parent")


def spanning_tree(nodes: DataFrame, min_samples: int = 10, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """w, lo, hi: the edges of the tree over nodes (node, x); none for fewer than two points."""
    empty = nodes.sparkSession.createDataFrame([], "w double, lo long, hi long")
    n = nodes.count()
    if n < 2:
        return empty
    places = nodes.groupBy("x").agg(F.min("node").alias("node"), F.count("*").alias("times"))
    placed, count = _placed(_cut(places), block)
    rows = _cut(placed.withColumn("core", F.lit(0.0)).withColumn("part", F.col("node")).withColumn("bound", F.lit(0.0)))
    k = min(min_samples, n - 1) + 1
    found = _cut(_nearest(_packed(rows), count, fan, k, max(k, NEAREST))).withColumnRenamed("node", "at")
    rows = _cut(rows.drop("core").join(found.select("at", "core", "floor"), F.col("node") == F.col("at")).select("node", "x", "times", "block", "pos", "core", "floor", "part"))
    reach = lambda c: rows.select(F.col("node").alias(c), F.col("core").alias(f"{c}_core"))
    pairs = found.select(F.col("at").alias("a"), F.explode("near").alias("e")).select("a", F.col("e.to").alias("b"), "e.d")
    listed = _cut(pairs.join(reach("a"), "a").join(reach("b"), "b").select("a", "b", F.greatest("d", "a_core", "b_core").alias("w")))
    first = rows.where("times > 1").select(F.col("x").alias("x_"), F.col("node").alias("lo"), F.col("core").alias("w"))
    copies = nodes.join(first, (F.col("x") == F.col("x_")) & (F.col("node") != F.col("lo"))).select("w", "lo", F.col("node").alias("hi"))
    tree = [empty, copies]
    while True:
        sizes = rows.groupBy("part").count().orderBy(F.desc("count"), "part").limit(2).collect()
        if len(sizes) < 2:
            return functools.reduce(DataFrame.unionByName, tree)
        chosen = _cut(_chosen(rows, listed, count, fan, sizes[0].part if sizes[0]["count"] > 1 else None))
        tree.append(chosen.select("w", "lo", "hi").distinct())
        up = _merged(chosen).select(F.col("part").alias("at"), "parent")
        rows = _cut(rows.join(up, F.col("part") == F.col("at"), "left").select(*[c for c in rows.columns if c != "part"], F.coalesce("parent", "part").alias("part")))
        side = lambda c: rows.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))  # noqa: E731, B023
        listed = _cut(listed.join(side("a"), "a").join(side("b"), "b").where("a_part <> b_part").select("a", "b", "w"))


def _chosen(rows: DataFrame, listed: DataFrame, count: int, fan: int, waits: int | None) -> DataFrame:
    """part, w, lo, hi, to: the least edge out of every part but the one that waits, from the lists where they tell it."""
    side = lambda c: rows.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    edges = listed.join(side("a"), "a").join(side("b"), "b")
    edge = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("b_part").alias("to"))
    least = _cut(edges.groupBy(F.col("a_part").alias("at")).agg(F.min(edge).alias("e")).select("at", "e"))
    searched = rows.where(F.col("part") != F.lit(waits)) if waits is not None else rows
    bounded = searched.join(least, F.col("part") == F.col("at"), "left").withColumn("bound", F.coalesce("e.w", F.lit(float("inf"))))
    active = _cut(bounded.where("floor <= bound").select("node", "x", "times", "block", "pos", "core", "part", "bound"))
    known = least.where(F.col("at") != F.lit(waits)) if waits is not None else least
    known = known.select(F.col("at").alias("part"), "e")
    left = active.count()
    if left:
        heads = max(1, min(count, math.ceil(left * count / rows.count())))
        mine = _packed(active.withColumn("pos", F.col("block") * BLOCK + F.col("pos")).withColumn("block", F.floor(F.col("block") * heads / count).cast("int")))
        others = _packed(rows.withColumn("bound", F.lit(0.0)))
        seen = _compared(mine, heads, others, count, min(fan, heads), lambda own, rest: _outward(own, _Boxes(rest)), "part long, w double, lo long, hi long, to long")
        known = known.union(seen.select("part", F.struct("w", "lo", "hi", "to").alias("e")))
    return known.groupBy("part").agg(F.min("e").alias("e")).select("part", "e.w", "e.lo", "e.hi", "e.to")
