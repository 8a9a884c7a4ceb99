"""Neighbour search over account feature points (D1 and the pair generation of D3/D4).

A theta self-join (distance ≤ r) plans as a broadcast nested loop; here it is an
**equi-join on grid cells** instead: points are hashed to cells of side r over three of the
four features, the probe side is exploded to its 27 neighbouring cells, and only candidate
pairs in touching cells are compared.  f1 (the z-score of the mean) is an affine copy of
f0, so the three indexed axes carry all the spread; the distance itself always uses all
four features.

Identical feature vectors (copies of one account profile — possibly a large share of all
accounts) are collapsed first into one point with a multiplicity, so copies never multiply
the number of pairs.  Counts ("k-th neighbour", "points within eps") use the multiplicity.

Points that differ by rounding noise only are not equal, and no side of a cell suits both them and the
rest.  So k-distances, counts within a radius and the spanning tree run on **blocks**: the axes are
cut at medians until a block holds about ``BLOCK`` points, blocks are compared with numpy, and the
bounding boxes tell which blocks a point must ask.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from acctlens.session import cut_lineage

FEATS = ["f0", "f1", "f2", "f3"]
IDX = ["f0", "f2", "f3"]
BLOCK = 1024                # points of a block, on average at most
DRAWN_MOST = 400_000        # rows drawn for the cuts
OFFSETS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def distinct_points(feat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points: pid, f0..f3, mult) and (mapping: Account, pid)."""
    pts = cut_lineage(feat.groupBy(*FEATS).agg(F.min("Account").alias("pid"), F.count(F.lit(1)).alias("mult")))
    mapping = feat.join(pts.select(*FEATS, "pid"), FEATS).select("Account", "pid")
    return pts, mapping


def _cell(c: str, side: float):
    return F.floor(F.col(c) / F.lit(side)).cast("long")


def pairs_within(probe: DataFrame, build: DataFrame, radius: float, carry: tuple = ()) -> DataFrame:
    """All (pid, qid, d, qmult) with Euclidean distance d ≤ radius (self pairs included), with the
    ``carry`` columns of ``build``."""
    off = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                              for a, b, c in OFFSETS])).alias("o")
    p = probe.select("pid", *[F.col(c).alias(f"p_{c}") for c in FEATS], off)
    p = p.select("*", *[(F.floor(F.col(f"p_{c}") / F.lit(radius)).cast("long") + F.col(f"o.{ax}")).alias(f"k{i}")
                        for i, (c, ax) in enumerate(zip(IDX, "abc"))]).drop("o")
    b = build.select(F.col("pid").alias("qid"), F.col("mult").alias("qmult"), *carry, *[F.col(c).alias(f"q_{c}") for c in FEATS],
                     *[_cell(c, radius).alias(f"k{i}") for i, c in enumerate(IDX)])
    d2 = sum(((F.col(f"p_{c}") - F.col(f"q_{c}")) ** 2 for c in FEATS), F.lit(0.0))
    # the planner sizes the exploded side by its files, 27 times too small for a broadcast
    j = p.join(b.hint("merge"), ["k0", "k1", "k2"])
    return j.select("pid", "qid", "qmult", *carry, F.sqrt(d2).alias("d")).where(F.col("d") <= F.lit(radius))


# ---------------------------------------------------------------- blocks

@dataclass
class Blocks:
    """Points cut into blocks along the axes, each with its bounding box."""
    points: DataFrame       # the points' columns and block
    block: np.ndarray       # of each box, in order
    lo: np.ndarray
    hi: np.ndarray
    held: np.ndarray        # accounts of each block


def split_tree(x: np.ndarray, size: int) -> list[tuple]:
    """(feature, threshold, left, right) or (-1, 0, block, 0) of each node: halves of the widest feature
    (left: x <= threshold) until at most ``size`` of the rows ``x`` are left."""
    nodes, todo, blocks = [None], [(0, x)], 0
    while todo:
        at, part = todo.pop()
        wide = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        if len(part) <= size or not wide.max() > 0:
            nodes[at], blocks = (-1, 0.0, blocks, 0), blocks + 1
            continue
        f = int(wide.argmax())
        values = np.sort(part[:, f])
        cut = values[(len(values) - 1) // 2]
        if cut == values[-1]:
            cut = values[np.searchsorted(values, cut) - 1]
        nodes[at] = (f, float(cut), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), part[part[:, f] <= cut]), (len(nodes) + 1, part[part[:, f] > cut])]
        nodes += [None, None]
    return nodes


def cut_into_blocks(points: DataFrame, size: int | None = None) -> Blocks:
    """``points`` (pid, f0..f3, mult, ...) in blocks of about ``size``.  The cuts come from rows drawn by
    hash (at most ``DRAWN_MOST``, some 64 a block), which matters for balance alone: wherever points lie
    close, near copies included, there are as many more blocks."""
    n, size = points.count(), size or BLOCK
    drawn = min(64 * math.ceil(n / size), DRAWN_MOST)
    sample = points if n <= size else points.where(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, drawn / n))))
    x = np.array([tuple(r) for r in sample.select(*FEATS).collect()], float).reshape(-1, len(FEATS)) if n > size else np.empty((0, len(FEATS)))
    nodes = split_tree(x, max(1, int(len(x) * size / max(n, 1))))
    feature, cut, left, right = (np.array(c) for c in zip(*nodes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = _rows(b), np.zeros(b.num_rows, np.int64)
            every = np.arange(b.num_rows)
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                at = np.where(inner, np.where(rows[every, feature[at]] <= cut[at], left[at], right[at]), at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(left[at].astype(np.int32))], names=[*b.schema.names, "block"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", block int"
    blocked = cut_lineage(points.mapInArrow(assign, kinds))
    boxes = np.array([tuple(r) for r in blocked.groupBy("block").agg(
        F.sum("mult"), *[F.min(c) for c in FEATS], *[F.max(c) for c in FEATS]).orderBy("block").collect()], float).reshape(-1, 2 + 2 * len(FEATS))
    k = len(FEATS)
    return Blocks(blocked, boxes[:, 0].astype(np.int64), boxes[:, 2: 2 + k], boxes[:, 2 + k:], boxes[:, 1])


def _rows(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(c).to_numpy() for c in FEATS])


def norms(parts: list[np.ndarray]) -> np.ndarray:
    """Distances from differences by feature, summed in the order of the join's formula: its rounding is
    monotone, so the bounds by boxes hold for the distances as computed."""
    s = parts[0] * parts[0]
    for p in parts[1:]:
        s = s + p * p
    return np.sqrt(s)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return norms([x[:, None, i] - y[None, :, i] for i in range(x.shape[1])])


def least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows by boxes: no point of the box is nearer to the row."""
    return norms([np.maximum(0.0, np.maximum(lo[None, :, i] - x[:, None, i], x[:, None, i] - hi[None, :, i])) for i in range(x.shape[1])])


def most(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows by boxes: no point of the box is farther from the row."""
    return norms([np.maximum(hi[None, :, i] - x[:, None, i], x[:, None, i] - lo[None, :, i]) for i in range(x.shape[1])])


def apart(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Boxes by boxes: no two points of the two are nearer."""
    return norms([np.maximum(0.0, np.maximum(los[None, :, i] - hi[:, None, i], lo[:, None, i] - his[None, :, i])) for i in range(lo.shape[1])])


def _kth(d: np.ndarray, mult: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` least distances of each row (fewer where there are fewer points), in order, and how many
    points each stands for."""
    n = min(k, d.shape[1])
    at = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(n), d.shape)
    d = np.take_along_axis(d, at, axis=1)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(d, order, axis=1), mult[np.take_along_axis(at, order, axis=1)]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _chunks(n: int) -> Iterator[slice]:
    return (slice(i, i + 256) for i in range(0, n, 256))


def k_distance(points: DataFrame, k: int, n_total: int | None = None) -> DataFrame:
    """(pid, kdist), the distance to the k-th nearest point counting the point itself and copies.
    The k nearest of a point's own block bound its distance; only the other blocks that come as near
    are asked, so the rows moved grow with the points, however close together these lie."""
    n = n_total if n_total is not None else points.agg(F.sum("mult")).first()[0]
    if n < k:
        raise ValueError(f"Expected n_neighbors <= n_samples, but n_samples = {n}, n_neighbors = {k}")
    cut = cut_into_blocks(points.select("pid", *FEATS, "mult"))
    names, lo, hi = cut.block, cut.lo, cut.hi

    def own(t: pa.Table) -> pa.Table:
        x, mult = _rows(t), t.column("mult").to_numpy()
        mine = int(t.column("block")[0].as_py())
        ds, ms, r = [], [], np.empty(len(x))
        for part in _chunks(len(x)):
            d, m = _kth(distances(x[part], x), mult, k)
            enough = m.cumsum(axis=1) >= k
            r[part] = np.where(enough.any(axis=1), np.take_along_axis(d, enough.argmax(axis=1)[:, None], axis=1)[:, 0], np.inf)
            ds += list(d)
            ms += list(m)
        others = np.flatnonzero((names != mine) & (apart(x.min(axis=0)[None], x.max(axis=0)[None], lo, hi)[0] <= r.max()))
        asked = []
        for part in _chunks(len(x)):
            near = least(x[part], lo[others], hi[others]) <= r[part, None]
            asked += [names[others[row]] for row in near]
        # the list of the nearest is needed only where another block is asked
        ds, ms = ([v if len(a) else v[:0] for v, a in zip(vs, asked)] for vs in (ds, ms))
        return pa.table({"pid": t.column("pid"), **{c: t.column(c) for c in FEATS}, "kdist": pa.array(r), "asked": _lists(asked, pa.int32()),
                         "ds": _lists(ds, pa.float64()), "ms": _lists(ms, pa.int64())})

    def other(here: pa.Table, there: pa.Table) -> pa.Table:
        got = []
        if here.num_rows and there.num_rows:
            x, y, r, mult = _rows(here), _rows(there), here.column("kdist").to_numpy(), there.column("mult").to_numpy()
            for part in _chunks(len(x)):
                d, m = _kth(distances(x[part], y), mult, k)
                row, at = np.nonzero(d <= r[part, None])
                got.append((row + part.start, d[row, at], m[row, at]))
        row, d, m = (np.concatenate(v) for v in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        return pa.table({"pid": here.column("pid").take(pa.array(row)), "d": pa.array(d, pa.float64()), "m": pa.array(m, pa.int64())})

    kind = points.schema["pid"].dataType.simpleString()
    first = cut_lineage(cut.points.groupBy("block").applyInArrow(own, f"pid {kind}, " + ", ".join(f"{c} double" for c in FEATS)
                                                                 + ", kdist double, asked array<int>, ds array<double>, ms array<long>"))
    done, open_ = first.where(F.size("asked") == 0).select("pid", "kdist"), first.where(F.size("asked") > 0)
    here = open_.select("pid", *FEATS, "kdist", F.explode("asked").alias("block"))
    more = here.groupBy("block").cogroup(cut.points.groupBy("block")).applyInArrow(other, f"pid {kind}, d double, m long")
    mine = open_.select("pid", F.explode(F.arrays_zip("ds", "ms")).alias("z")).select("pid", F.col("z.ds").alias("d"), F.col("z.ms").alias("m"))
    w = Window.partitionBy("pid").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = (more.unionByName(mine).withColumn("cm", F.sum("m").over(w)).where(F.col("cm") >= k).groupBy("pid").agg(F.min("d").alias("kdist")))
    return done.unionByName(cut_lineage(rest))


def counts_within(points: DataFrame, radius: float) -> DataFrame:
    """(pid, n): the accounts within ``radius`` of each point, itself and copies included.  Blocks that lie
    within it as a whole are added up by their boxes; distances are taken block against block, and
    only counts leave a task."""
    cut = cut_into_blocks(points.select("pid", *FEATS, "mult"))
    names, lo, hi, held = cut.block, cut.lo, cut.hi, cut.held

    def count(x: np.ndarray, y: np.ndarray, mult: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *((distances(x[part], y) <= radius) @ mult for part in _chunks(len(x)))])

    def own(t: pa.Table) -> pa.Table:
        x, mine = _rows(t), int(t.column("block")[0].as_py())
        n = count(x, x, t.column("mult").to_numpy())
        others = np.flatnonzero((names != mine) & (apart(x.min(axis=0)[None], x.max(axis=0)[None], lo, hi)[0] <= radius))
        asked = []
        for part in _chunks(len(x)):
            whole = most(x[part], lo[others], hi[others]) <= radius
            n[part] += (whole @ held[others]).astype(np.int64)
            asked += [names[others[row]] for row in ~whole & (least(x[part], lo[others], hi[others]) <= radius)]
        return pa.table({"pid": t.column("pid"), **{c: t.column(c) for c in FEATS}, "n": pa.array(n, pa.int64()), "asked": _lists(asked, pa.int32())})

    def other(here: pa.Table, there: pa.Table) -> pa.Table:
        n = count(_rows(here), _rows(there), there.column("mult").to_numpy()) if here.num_rows and there.num_rows else np.zeros(here.num_rows, np.int64)
        return pa.table({"pid": here.column("pid"), "n": pa.array(n, pa.int64())})

    kind = points.schema["pid"].dataType.simpleString()
    first = cut_lineage(cut.points.groupBy("block").applyInArrow(own, f"pid {kind}, " + ", ".join(f"{c} double" for c in FEATS) + ", n long, asked array<int>"))
    more = (first.select("pid", *FEATS, F.explode("asked").alias("block")).groupBy("block").cogroup(cut.points.groupBy("block"))
            .applyInArrow(other, f"pid {kind}, n long"))
    return first.select("pid", "n").unionByName(more).groupBy("pid").agg(F.sum("n").alias("n"))
