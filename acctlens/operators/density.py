"""Density-based detection over accounts.

D2: eps = linearly interpolated percentile of the k-distances (exact, skew-safe quantile).
D3: DBSCAN noise without clustering: a point is core when at least ``min_samples`` points
    (itself and copies included) lie within eps, inclusive; noise = not core and no core
    point within eps.
D4: cluster labels = connected components of the core–core graph; a
    border point takes the smallest label among its core neighbours.

Dense cells.  Points fall into cells of side eps/2 over the four features.  A cell whose points'
bounding box has a diagonal of at most eps and that holds ``min_samples`` of them is *dense*: all
its points are core and belong to one cluster, so they are one node of the graph, and no two of
them are compared.  Only the points of other cells look for their neighbours (the grid equi-join of
``neighbors``), counted by node before they are written.  A place holds a bounded number of such
points, so the pairs grow with the points, not with their square.

Whether two dense cells touch is told from their bounding boxes and one point of each; what stays
open, and would join two components, is halved along every feature until the boxes decide or few
enough points are left to be compared.  Boxes and points use one formula of the distance, whose
rounding is monotone, so every decision equals that of comparing all pairs.

HDBSCAN (D5) lives in ``hdbscan.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctlens.functions.median import global_quantile
from acctlens.functions.components import component_roots
from acctlens.operators.neighbors import FEATS, IDX, OFFSETS, counts_within, distinct_points, k_distance, pairs_within
from acctlens.session import cut_lineage

DIRECT = 4096        # pairs of points that two open boxes may hold to be compared one by one
HALVINGS = 40        # beyond, whatever the boxes hold is compared


@dataclass
class DBSCANResult:
    eps: float
    flags: DataFrame        # Account, pid, kdist, is_core, dbscan_outlier
    points: DataFrame       # pid, f0..f3, mult, cell, dense, node
    links: DataFrame        # pid (of no dense cell), node, dense, n: accounts of the node within eps
    core: DataFrame         # core: the core points of no dense cell


def eps_from_kdist(kd_accounts: DataFrame, percentile: float, n: int | None = None) -> float:
    """D2 over accounts (each account carries its own k-distance)."""
    return float(global_quantile(kd_accounts, "kdist", percentile / 100.0, n_rows=n))


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(sum((x ** 2 for x in parts), F.lit(0.0)))


def _cells(side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / F.lit(side)).cast("long") for c in FEATS])


def _boxes(points: DataFrame, *by: str) -> DataFrame:
    """``by`` and box: the bounds of a group's points, their number and the one of the least pid."""
    return points.groupBy(*by).agg(F.struct(
        *[F.min(c).alias(f"lo_{c}") for c in FEATS], *[F.max(c).alias(f"hi_{c}") for c in FEATS],
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*FEATS), "pid").alias("one")).alias("box"))


def _least(x: Column, y: Column) -> Column:
    return _norm([F.greatest(F.lit(0.0), x[f"lo_{c}"] - y[f"hi_{c}"], y[f"lo_{c}"] - x[f"hi_{c}"]) for c in FEATS])


def _touch(x: Column, y: Column, eps: float) -> Column:
    most = _norm([F.greatest(x[f"hi_{c}"] - y[f"lo_{c}"], y[f"hi_{c}"] - x[f"lo_{c}"]) for c in FEATS])
    return (most <= eps) | (_norm([x["one"][c] - y["one"][c] for c in FEATS]) <= eps)


def with_cells(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``points`` with cell, dense and node: the least pid of a dense cell, else the point's own."""
    held = points.withColumn("cell", _cells(eps / 2))
    spread = _norm([F.max(c) - F.min(c) for c in FEATS])
    cells = (held.groupBy("cell").agg(F.sum("mult").alias("held"), spread.alias("spread"), F.min("pid").alias("first"))
             .where((F.col("held") >= min_samples) & (F.col("spread") <= F.lit(eps))).select("cell", "first"))
    return held.join(cells, "cell", "left").select(
        *points.columns, "cell", F.col("first").isNotNull().alias("dense"), F.coalesce("first", "pid").alias("node"))


def dbscan(feat: DataFrame, k: int = 5, eps_percentile: float = 90, min_samples: int = 5,
           eps: float | None = None) -> DBSCANResult:
    """D1–D3 on the standardised feature matrix (Account, f0..f3)."""
    pts, mapping = distinct_points(feat)
    n = feat.count()
    kd = k_distance(pts, k, n)
    kd_acc = cut_lineage(mapping.join(kd, "pid").select("Account", "pid", "kdist"))
    if eps is None:
        eps = eps_from_kdist(kd_acc, eps_percentile, n)
    if not eps or eps <= 0:
        raise ValueError(f"eps must be > 0 (got {eps}); too many identical accounts")
    points = cut_lineage(with_cells(pts, eps, min_samples))
    links = cut_lineage(pairs_within(points.where(~F.col("dense")), points, eps, ("node", "dense"))
                        .groupBy("pid", "node", "dense").agg(F.sum("qmult").alias("n")))
    core = cut_lineage(links.groupBy("pid").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples)
                       .select(F.col("pid").alias("core")))
    reach = (links.join(core, F.col("node") == F.col("core"), "left").where(F.col("dense") | F.col("core").isNotNull())
             .select("pid").distinct().withColumn("reach", F.lit(True)))
    state = (points.select("pid", "dense").join(core, F.col("pid") == F.col("core"), "left").join(reach, "pid", "left")
             .select("pid", (F.col("dense") | F.col("core").isNotNull()).alias("is_core"),
                     (~(F.col("dense") | F.col("reach").isNotNull())).cast("int").alias("dbscan_outlier")))
    flags = kd_acc.join(state, "pid").select("Account", "pid", "kdist", "is_core", "dbscan_outlier")
    return DBSCANResult(eps, cut_lineage(flags), points, links, core)


def within_counts(res: DBSCANResult) -> DataFrame:
    """Account, n_within: the accounts within eps, itself included.  By definition this looks at
    every pair within eps; nothing else here does."""
    n = counts_within(res.points, res.eps)
    return (res.flags.select("Account", "pid").join(n.select("pid", F.col("n").cast("long").alias("n_within")), "pid")
            .select("Account", "n_within"))


def _compared(open_: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """(a, b) of the open boxes that hold two points within eps."""
    def side(p):
        return points.select(F.col("node").alias(p), F.col("cell").alias(f"{p}_cell"), *[F.col(c).alias(f"{p}_{c}") for c in FEATS])
    d = _norm([F.col(f"a_{c}") - F.col(f"b_{c}") for c in FEATS])
    return (open_.select("a", "a_cell", "b", "b_cell").join(side("a"), ["a", "a_cell"]).join(side("b"), ["b", "b_cell"])
            .where(d <= F.lit(eps)).select("a", "b").distinct())


def touching_cells(points: DataFrame, eps: float) -> DataFrame:
    """Edges (a, b) between dense cells, by node: with them, cells are connected exactly if points
    within eps of each other connect them.  Pairs of one component are not all told."""
    dense = points.where("dense")
    cells = cut_lineage(_boxes(dense, "node", "cell"))
    # boxes are at most eps/2 wide, so the lower bounds of two within eps differ by 1.5 eps at most
    place = lambda c, o: F.floor(F.col(f"box.lo_{c}") / F.lit(1.6 * eps)).cast("long") + o
    off = F.explode(F.array(*[F.array(*map(F.lit, o)) for o in OFFSETS])).alias("o")
    left = cells.select(F.col("node").alias("a"), F.col("cell").alias("a_cell"), F.col("box").alias("x"), off, "box")
    left = left.select("a", "a_cell", "x", *[place(c, F.col("o")[i]).alias(f"k{i}") for i, c in enumerate(IDX)])
    right = cells.select(F.col("node").alias("b"), F.col("cell").alias("b_cell"), F.col("box").alias("y"),
                         *[place(c, F.lit(0)).alias(f"k{i}") for i, c in enumerate(IDX)])

    def judged(pairs: DataFrame) -> DataFrame:
        x, y = F.col("x"), F.col("y")
        return cut_lineage(pairs.where(_least(x, y) <= F.lit(eps)).select(
            "a", "a_cell", "b", "b_cell", _touch(x, y, eps).alias("touch"), (x["n"] * y["n"]).alias("pairs")))

    found = judged(left.join(right.hint("merge"), ["k0", "k1", "k2"]).where(F.col("a") < F.col("b")))
    edges = found.where("touch").select("a", "b")
    open_ = found.where(~F.col("touch"))
    if open_.isEmpty():
        return edges
    roots = cut_lineage(component_roots(edges))
    for side in ("a", "b"):                              # only what could join two components
        open_ = (open_.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
                 .withColumn(f"{side}_root", F.coalesce(f"{side}_root", side)))
    open_ = cut_lineage(open_.where(F.col("a_root") != F.col("b_root")).select("a", "a_cell", "b", "b_cell", "pairs"))
    for level in range(1, HALVINGS + 2):
        few = F.col("pairs") <= (DIRECT if level <= HALVINGS else float("inf"))
        told = cut_lineage(_compared(open_.where(few), dense, eps))
        edges = edges.unionByName(told)
        open_ = open_.where(~few).join(told, ["a", "b"], "left_anti")
        if open_.isEmpty():
            return edges
        nodes = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        dense = cut_lineage(dense.join(nodes, "node", "left_semi").withColumn("up", F.col("cell"))
                            .withColumn("cell", _cells(eps / 2 ** (level + 1))))
        kids = cut_lineage(_boxes(dense, "node", "up", "cell"))
        some = lambda p, box: kids.select(F.col("node").alias(p), F.col("up").alias(f"{p}_cell"),
                                          F.col("cell").alias(f"{p}_kid"), F.col("box").alias(box))
        found = judged(open_.select("a", "a_cell", "b", "b_cell").join(some("a", "x"), ["a", "a_cell"]).join(some("b", "y"), ["b", "b_cell"])
                       .drop("a_cell", "b_cell").withColumnsRenamed({"a_kid": "a_cell", "b_kid": "b_cell"}))
        told = cut_lineage(found.where("touch").select("a", "b").distinct())
        edges = edges.unionByName(told)
        open_ = cut_lineage(found.where(~F.col("touch")).drop("touch").join(told, ["a", "b"], "left_anti"))
        dense = dense.drop("up")
    return edges


def cluster_labels(res: DBSCANResult) -> DataFrame:
    """Account, cluster (the smallest core pid of its component; NULL for noise).
    A border point takes the smallest label among its core neighbours."""
    lone = res.core.select(F.col("core").alias("node"))
    linked = res.links.join(res.core, F.col("pid") == F.col("core"), "left_semi").where(F.col("pid") != F.col("node"))
    edges = (linked.where("dense").select("pid", "node").unionByName(
        linked.where(~F.col("dense")).join(lone, "node", "left_semi").select("pid", "node"))
        .select(F.least("pid", "node").alias("a"), F.greatest("pid", "node").alias("b")).distinct())
    roots = component_roots(edges.unionByName(touching_cells(res.points, res.eps)))
    nodes = res.points.where("dense").select("node").distinct().unionByName(lone)
    lab = cut_lineage(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("lab")))
    own = res.points.select("pid", "node").join(lab, "node").select("pid", "lab")
    border = (res.links.join(res.core, F.col("pid") == F.col("core"), "left_anti").join(lab, "node")
              .groupBy("pid").agg(F.min("lab").alias("lab")))
    return res.flags.join(own.unionByName(border), "pid", "left").select("Account", F.col("lab").alias("cluster"))


def cluster_count(labels: DataFrame) -> int:
    return labels.where(F.col("cluster").isNotNull()).select("cluster").distinct().count()
