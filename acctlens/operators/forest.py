"""Isolation Forest over accounts (D6) and the contamination threshold.

Everything random is a hash and everything that is compared is an integer, so any engine with MD5
can replay the forest exactly; a run depends on the seed and the accounts alone, not on
partitioning, executor count or library.

* Features lie on a grid of 1e-9 standard deviations (``on_grid``), which also keeps values that differ
  by rounding noise from being split.
* Sampling: tree t takes the ``max_samples`` accounts with the smallest ``draw(seed, t, Account)``.  A hash
  pre-filter keeps about 4·max_samples candidates per tree before the per-tree ranking, so nothing
  close to (trees × accounts) is shuffled; a tree that got too few candidates is redone without it.
* Growing: level by level, all trees at once.  A level is one window over (tree, node): count and
  range of each feature, a drawn feature among those with a range, a drawn threshold inside it.  One
  shuffle by tree serves all levels, as no node leaves its tree; a tree has at most ``max_samples`` rows.
* Scoring: the node table has at most trees × (2·max_samples − 1) rows — a proven bound — and
  is shipped to the executors; ``mapInPandas`` walks each batch of accounts down all trees.
  score = −2^(−E[h(x)] / c(ψ)), lower = more anomalous; path lengths are summed in units of 2^-20.

The random stream cannot equal another library's; the contract is the algorithm and D7 exactness
given the scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from acctlens.functions.median import global_quantile
from acctlens.session import cut_lineage

FEATS = ["f0", "f1", "f2", "f3"]
CELLS = ["q0", "q1", "q2", "q3"]
EULER_GAMMA = 0.5772156649015329
GRID = 1e9                                               # cells a unit of the features
UNIT = 1 << 20                                           # path lengths are whole numbers of 1 / UNIT
DRAWS = 1 << 52                                          # draws are whole numbers below this


def avg_path_length(n):
    """c(n): average unsuccessful-search path length of a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def draw(*parts: Column | int | str) -> Column:
    """A whole number below 2**52: the first 13 hex digits of the MD5 of the parts, colon-joined."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def on_grid(feat: DataFrame) -> DataFrame:
    """Account, q0..q3: the features in grid cells."""
    return feat.select("Account", *(F.floor(F.col(f) * GRID + 0.5).cast("long").alias(q) for f, q in zip(FEATS, CELLS)))


def max_depth_of(psi: int) -> int:
    return math.ceil(math.log2(max(psi, 2)))


def sample_trees(cells: DataFrame, n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, Account, q0..q3) — the ψ accounts with the smallest draw per tree."""
    frac = min(1.0, 4.0 * psi / max(n, 1) + 64.0 / max(n, 1))
    ex = cells.select("Account", *CELLS, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    ex = ex.select("*", draw(seed, F.col("tree"), F.col("Account")).alias("u"))
    w = Window.partitionBy("tree").orderBy("u", "Account")
    pick = (ex.where(F.col("u") < F.lit(int(frac * DRAWS))) if frac < 1.0 else ex)
    s = cut_lineage(pick.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= psi).drop("rk"))
    sizes = s.groupBy("tree").count().collect()          # n_trees rows
    if len(sizes) < n_trees or any(r["count"] < psi for r in sizes):
        s = cut_lineage(ex.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= psi).drop("rk"))
    return s


def grow_forest(sample: DataFrame, psi: int, seed: int) -> DataFrame:
    """tree, node, feature, threshold, size: inner nodes with feature and threshold (left: cell <= threshold),
    leaves with their number of sample points.  The root is 1, the children of i are 2i and 2i + 1."""
    node = Window.partitionBy("tree", "node")
    rows = sample.select("tree", *CELLS, F.lit(1).cast("long").alias("node"),
                         F.array().cast("array<struct<node:long,feature:int,threshold:long>>").alias("path")).repartition("tree")
    for _ in range(max_depth_of(psi)):
        ranges = [c for i, q in enumerate(CELLS) for c in (F.min(q).over(node).alias(f"lo{i}"), F.max(q).over(node).alias(f"hi{i}"))]
        rows = rows.select("*", *ranges)
        wide = F.filter(F.array(*(F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), F.lit(i)) for i in range(len(CELLS)))), lambda x: x.isNotNull())
        rows = rows.withColumn("wide", wide)
        pick = F.pmod(draw(seed, F.col("tree"), F.col("node"), "f"), F.greatest(F.size("wide"), F.lit(1))).cast("int")
        rows = rows.withColumn("k", F.get("wide", pick))
        of = lambda name: F.get(F.array(*(F.col(f"{name}{i}") for i in range(len(CELLS)))), F.col("k"))
        share = draw(seed, F.col("tree"), F.col("node"), "t") / F.lit(float(DRAWS))
        rows = rows.withColumn("cut", of("lo") + F.floor(share * (of("hi") - of("lo"))))
        step = F.array(F.struct("node", F.col("k").alias("feature"), F.col("cut").alias("threshold")))
        rows = rows.select("tree", *CELLS,
                           F.when(F.col("k").isNull(), F.col("node")).otherwise(2 * F.col("node") + (of("q") > F.col("cut")).cast("long")).alias("node"),
                           F.when(F.col("k").isNull(), F.col("path")).otherwise(F.concat("path", step)).alias("path"))
    rows = cut_lineage(rows.select("tree", "node", "path"))
    inner = rows.select("tree", F.explode("path").alias("s")).select("tree", "s.*").distinct()
    leaves = rows.groupBy("tree", "node").agg(F.count("*").alias("size"))
    return inner.select("*", F.lit(0).cast("long").alias("size")).unionByName(
        leaves.select("tree", "node", F.lit(-1).alias("feature"), F.lit(0).cast("long").alias("threshold"), "size"))


def score(cells: DataFrame, nodes: pd.DataFrame, psi: int) -> DataFrame:
    """Account, if_score (= score_samples: lower is more anomalous)."""
    depth = max_depth_of(psi)
    trees = []
    for _, g in nodes.groupby("tree"):
        feature, threshold, path = np.full(2 << depth, -1), np.zeros(2 << depth, np.int64), np.zeros(2 << depth, np.int64)
        at = g["node"].to_numpy()
        feature[at], threshold[at] = g["feature"], g["threshold"]
        levels = np.frexp(at.astype(float))[1] - 1
        path[at] = levels * UNIT + np.floor(avg_path_length(g["size"].to_numpy()) * UNIT + 0.5).astype(np.int64)
        trees.append((feature, threshold, path))
    whole = float(avg_path_length(np.array([psi]))[0]) * len(trees) * UNIT

    def run(it):
        for pdf in it:
            x = pdf[CELLS].to_numpy(np.int64)
            every = np.arange(len(x))
            h = np.zeros(len(x), np.int64)
            for feature, threshold, path in trees:
                node = np.ones(len(x), np.int64)
                for _ in range(depth):
                    f = feature[node]
                    node = np.where(f < 0, node, 2 * node + (x[every, f] > threshold[node]))
                h += path[node]
            ratio = h / whole if whole else np.ones(len(x))
            yield pd.DataFrame({"Account": pdf["Account"], "if_score": -np.power(2.0, -ratio)})

    return cells.select("Account", *CELLS).mapInPandas(run, "Account string, if_score double")


def isolation_forest(feat: DataFrame, contamination: float = 0.10, n_trees: int = 100,
                     max_samples: int = 256, seed: int = 42) -> tuple[DataFrame, float]:
    """D6 + D7: (Account, if_score, iforest_outlier) and the threshold."""
    cells = cut_lineage(on_grid(feat))
    n = cells.count()
    psi = min(max_samples, n)
    nodes = grow_forest(sample_trees(cells, n, n_trees, psi, seed), psi, seed).toPandas()
    sc = cut_lineage(score(cells, nodes, psi))
    thr = contamination_threshold(sc, "if_score", contamination, n)
    return sc.select("Account", "if_score", (F.col("if_score") < F.lit(thr)).cast("int").alias("iforest_outlier")), thr


def contamination_threshold(scores: DataFrame, col: str, contamination: float, n: int | None = None) -> float:
    """The contamination percentile of the scores (exact, linear interpolation)."""
    return float(global_quantile(scores, col, contamination, n_rows=n))
