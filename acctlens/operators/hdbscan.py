"""HDBSCAN noise flags over accounts (D5), distributed end to end.

1. Core distance = distance to the ``min_samples``-th point counting itself (D1's grid search).
2. Minimum spanning tree of the mutual-reachability graph, mrd(p, q) = max(core p, core q, d), **by
   blocks** of the space: the tree of every block, then of every pair of blocks that may hold an edge
   of the whole tree (bounding boxes tell), and the spanning forest of these edges, by Kruskal in one
   task for up to ``ONE_TASK`` edges, else by Borůvka rounds: each component's least outgoing edge by a grouped
   minimum, then the components merge.  Ties break on (w, u, v).  Identical accounts (one distinct
   point with a multiplicity) hang off their representative by star edges of weight core(p) — the
   exact tree of the full graph.
3. **Condensation** (single-linkage order, ``min_cluster_size``) of the tree's n - 1 edges only: they
   are range-partitioned by weight into batches of at most ``batch_edges``; batches run in order, each
   in one task with a union-find over only the components its edges touch (a component smaller than
   ``min_cluster_size`` carries its member list, so state stays bounded).  Output: the condensed
   tree rows — points falling out of a cluster at λ = 1/w, and child clusters born at a split.
4. **Excess of mass**: stability per cluster from the condensed rows (a grouped aggregate), then
   the bottom-up selection and the top-down "nearest selected ancestor" pass.  The cluster tree
   has at most 2·accounts/min_cluster_size nodes; up to TREE_CAP nodes one task runs both passes,
   beyond it they run as per-level rounds and pointer jumping.  Points are labelled by one join.
   The root is never selectable, so a single blob leaves every account as noise, as in the
   library the reference calls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.functions.components import component_roots
from acctlens.operators.neighbors import FEATS, _rows, apart, cut_into_blocks, distinct_points, k_distance, norms
from acctlens.session import cut_lineage

BATCH_EDGES = 200_000
CID_STRIDE = 1_000_000_000


# ------------------------------------------------------------------ 2. spanning tree

TREE_BLOCK = 1024         # points of a block, on average at most
BLOCKS_MOST = 4096        # beyond, blocks grow: the driver holds their boxes and judges their pairs


def _prim(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w): the minimum spanning tree of mutual reachability, ties broken on (w, u, v); u < v are
    places of the rows, which are in the order of their names.  One row of distances at a time."""
    n = len(x)
    every = np.arange(n)
    w, via, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    us, vs, ws, at = [], [], [], 0
    for _ in range(n - 1):
        left[at] = False
        d = np.maximum(np.maximum(core[at], core), norms([x[at, i] - x[:, i] for i in range(x.shape[1])]))
        new, old = np.minimum(at, every) * n + np.maximum(at, every), np.minimum(via, every) * n + np.maximum(via, every)
        better = left & ((d < w) | ((d == w) & (new < old)))
        w[better], via[better] = d[better], at
        open_ = np.where(left, w, np.inf)
        ties = np.flatnonzero(left & (w == open_.min()))
        at = int(ties[np.argmin(np.minimum(via[ties], ties) * n + np.maximum(via[ties], ties))])
        us.append(min(at, via[at]))
        vs.append(max(at, via[at]))
        ws.append(w[at])
    return np.array(us, np.int64), np.array(vs, np.int64), np.array(ws, float)


def _block_tree(t: pa.Table) -> pa.Table:
    """The tree of one block, or the edges between the two of a pair that are in the tree of both."""
    t = t.sort_by("pid")
    u, v, w = _prim(_rows(t), t.column("core").to_numpy())
    block, a, b = t.column("block").to_numpy(), t.column("a")[0].as_py(), t.column("b")[0].as_py()
    if a != b:
        cross = block[u] != block[v]
        u, v, w = u[cross], v[cross], w[cross]
    pid = t.column("pid")
    return pa.table({"u": pid.take(pa.array(u)), "v": pid.take(pa.array(v)), "w": pa.array(w, pa.float64()),
                     "a": pa.array(np.full(len(u), a), pa.int32()), "b": pa.array(np.full(len(u), b), pa.int32())})


def _minimax(n: int, edges: list[tuple[float, int, int]]) -> np.ndarray:
    """Between any two of n blocks, the least of the largest weights of a way (inf: none)."""
    out, group, member = np.full((n, n), np.inf), list(range(n)), {i: [i] for i in range(n)}
    for w, a, b in sorted(edges):
        a, b = group[a], group[b]
        if a != b:
            out[np.ix_(member[a], member[b])] = w
            out[np.ix_(member[b], member[a])] = w
            if len(member[a]) < len(member[b]):
                a, b = b, a
            for x in member[b]:
                group[x] = a
            member[a] += member.pop(b)
    return out


ONE_TASK = 200_000                                        # edges that one task may sort and join


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    e = pa.Table.from_batches(held).sort_by([("w", "ascending"), ("u", "ascending"), ("v", "ascending")])
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    keep = []
    for i, (a, b) in enumerate(zip(e["cu"].to_pylist(), e["cv"].to_pylist())):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            keep.append(i)
    yield from e.select(["u", "v", "w"]).take(pa.array(keep, pa.int64())).combine_chunks().to_batches()


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v, w): the minimum spanning forest, between the components cu, cv, of ``edges`` (u, v, w, cu,
    cv), ties broken on (w, u, v)."""
    edges = cut_lineage(edges)
    if edges.count() <= ONE_TASK:
        return cut_lineage(edges.coalesce(1).mapInArrow(_kruskal, edges.select("u", "v", "w").schema))
    tree = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            return tree
        e = F.struct("w", "u", "v", "cu", "cv").alias("e")
        ends = edges.select(F.col("cu").alias("c"), e).union(edges.select(F.col("cv").alias("c"), e))
        least = cut_lineage(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        tree = least.select("u", "v", "w") if tree is None else tree.unionByName(least.select("u", "v", "w"))
        roots = component_roots(least.select(F.col("cu").alias("a"), F.col("cv").alias("b")))
        for c in ("cu", "cv"):
            edges = (edges.join(roots.select(F.col("node").alias(c), F.col("root").alias("__r")), c, "left")
                     .withColumn(c, F.coalesce("__r", c)).drop("__r"))
        edges = cut_lineage(edges.where(F.col("cu") != F.col("cv")))
    raise RuntimeError(f"no spanning forest within {max_rounds} rounds")


# ------------------------------------------------------------------ 3. condensation

_OUT_SCHEMA = ("kind string, acct string, cid long, parent long, lam double, size long, "
               "old_root string, new_root string, members array<string>")


def _process_batch(mcs: int, batch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        comps = pdf[pdf.kind == "c"]
        edges = pdf[pdf.kind == "e"].sort_values(["w", "u", "v"], kind="stable")
        size = dict(zip(comps.root, comps["size"].astype(int)))
        cid = {r: (None if pd.isna(c) else int(c)) for r, c in zip(comps.root, comps.cid)}
        mem = {r: (list(m) if isinstance(m, (list, tuple)) or hasattr(m, "__len__") else None)
               for r, m in zip(comps.root, comps.members)}
        parent = {r: r for r in comps.root}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        rows = []
        counter = 0
        for ru, rv, w in zip(edges.ru, edges.rv, edges.w):
            a, b = find(ru), find(rv)
            if a == b:
                continue
            lam = math.inf if w <= 0 else 1.0 / w
            big_a, big_b = size[a] >= mcs, size[b] >= mcs
            if big_a and big_b:
                counter += 1
                x = batch * CID_STRIDE + counter
                rows.append(("k", None, cid[a], x, lam, size[a], None, None, None))
                rows.append(("k", None, cid[b], x, lam, size[b], None, None, None))
                new_cid, new_mem = x, None
            elif big_a or big_b:
                keep, small = (a, b) if big_a else (b, a)
                new_cid, new_mem = cid[keep], None
                rows += [("p", m, new_cid, None, lam, 1, None, None, None) for m in mem[small]]
            elif size[a] + size[b] >= mcs:
                counter += 1
                new_cid, new_mem = batch * CID_STRIDE + counter, None
                rows += [("p", m, new_cid, None, lam, 1, None, None, None) for m in mem[a] + mem[b]]
            else:
                new_cid, new_mem = None, mem[a] + mem[b]
            keep_root, gone = (a, b) if a <= b else (b, a)
            parent[gone] = keep_root
            size[keep_root] = size[a] + size[b]
            cid[keep_root], mem[keep_root] = new_cid, new_mem
        for r in list(parent):
            f = find(r)
            if f != r:
                rows.append(("r", None, None, None, None, None, r, f, None))
        for r in parent:
            if find(r) == r:
                rows.append(("s", None, cid[r], None, None, size[r], r, r, mem[r]))
        cols = list(zip(*rows)) if rows else [[] for _ in range(9)]
        return pd.DataFrame({
            "kind": pd.Series(cols[0], dtype=object), "acct": pd.Series(cols[1], dtype=object),
            "cid": pd.array(cols[2], dtype="Int64"), "parent": pd.array(cols[3], dtype="Int64"),
            "lam": pd.array([math.nan if v is None else v for v in cols[4]], dtype="float64"),
            "size": pd.array(cols[5], dtype="Int64"), "old_root": pd.Series(cols[6], dtype=object),
            "new_root": pd.Series(cols[7], dtype=object), "members": pd.Series(cols[8], dtype=object)})
    return run


class Condenser:
    """Kruskal-order condensation with union-find state kept as two tables (account → root,
    root → size / cluster id / members of a small component).  ``feed`` takes edges (u, v, w)
    that are all at least as heavy as every edge fed before."""

    def __init__(self, accounts: DataFrame, mcs: int, batch_edges: int = BATCH_EDGES):
        self.spark = accounts.sparkSession
        self.mcs, self.batch_edges = mcs, batch_edges
        self.root = cut_lineage(accounts.select("acct", F.col("acct").alias("root")))
        self.comp = cut_lineage(accounts.select(F.col("acct").alias("root"), F.lit(1).cast("long").alias("size"),
                                                F.lit(None).cast("long").alias("cid"), F.array("acct").alias("members")))
        self.pts_out, self.cl_out = [], []
        self.batch_no = 0

    def feed(self, edges: DataFrame) -> None:
        n_edges = edges.count()
        if n_edges == 0:
            return
        n_batches = max(1, math.ceil(n_edges / self.batch_edges))
        if n_batches == 1:                 # one bounded batch: the task sorts it itself
            self._batch(edges)
            return
        E = cut_lineage(edges.repartitionByRange(n_batches, "w", "u", "v").withColumn("batch", F.spark_partition_id()))
        for b in range(n_batches):
            self._batch(E.where(F.col("batch") == b))

    def _batch(self, e: DataFrame) -> None:
        root, comp = self.root, self.comp
        eb = cut_lineage(e.join(root.select(F.col("acct").alias("u"), F.col("root").alias("ru")), "u")
                         .join(root.select(F.col("acct").alias("v"), F.col("root").alias("rv")), "v")
                         .where(F.col("ru") != F.col("rv")))
        if eb.isEmpty():
            return
        self.batch_no += 1
        b = self.batch_no
        touched = eb.select(F.col("ru").alias("root")).union(eb.select(F.col("rv").alias("root"))).distinct()
        cstate = comp.join(touched, "root", "left_semi")
        both = (eb.select(F.lit("e").alias("kind"), "u", "v", "w", "ru", "rv", F.lit(None).cast("string").alias("root"),
                          F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("cid"),
                          F.lit(None).cast("array<string>").alias("members"))
                .unionByName(cstate.select(F.lit("c").alias("kind"), F.lit(None).cast("string").alias("u"),
                                           F.lit(None).cast("string").alias("v"), F.lit(None).cast("double").alias("w"),
                                           F.lit(None).cast("string").alias("ru"), F.lit(None).cast("string").alias("rv"),
                                           "root", "size", "cid", "members")))
        out = cut_lineage(both.groupBy(F.lit(b).alias("__b")).applyInPandas(_process_batch(self.mcs, b), _OUT_SCHEMA))
        self.pts_out.append(out.where(F.col("kind") == "p").select("acct", "cid", "lam"))
        self.cl_out.append(out.where(F.col("kind") == "k").select("cid", "parent", "lam", "size"))
        rel = out.where(F.col("kind") == "r").select("old_root", "new_root")
        self.root = cut_lineage(root.join(rel, root.root == rel.old_root, "left")
                                .select("acct", F.coalesce("new_root", "root").alias("root")))
        states = out.where(F.col("kind") == "s").select(F.col("new_root").alias("root"), "size", "cid", "members")
        self.comp = cut_lineage(comp.join(touched, "root", "left_anti").unionByName(states))

    def result(self):
        """(points: acct, cid, lam), (clusters: cid, parent, lam, size), root cluster id."""
        pts = self.pts_out[0] if self.pts_out else self.spark.createDataFrame([], "acct string, cid long, lam double")
        for x in self.pts_out[1:]:
            pts = pts.unionByName(x)
        cls = self.cl_out[0] if self.cl_out else self.spark.createDataFrame([], "cid long, parent long, lam double, size long")
        for x in self.cl_out[1:]:
            cls = cls.unionByName(x)
        final = self.comp.agg(F.max_by("cid", "size").alias("cid"), F.max("size").alias("size")).first()
        root_cid = final["cid"] if final["size"] is not None and final["size"] >= self.mcs else None
        return cut_lineage(pts), cut_lineage(cls), root_cid


def condense(edges: DataFrame, accounts: DataFrame, mcs: int, batch_edges: int = BATCH_EDGES):
    """Condensed tree of a spanning tree (u, v, w) over ``accounts`` (acct)."""
    c = Condenser(accounts, mcs, batch_edges)
    c.feed(edges)
    return c.result()


# ------------------------------------------------------------------ 4. excess of mass

TREE_CAP = 2_000_000      # cluster-tree nodes handled in one task (≤ 2·accounts / min_cluster_size)


def _eom_single_task(root_cid: int):
    """Bottom-up excess-of-mass selection and the nearest selected ancestor of every cluster,
    over the whole (bounded) cluster tree in one task."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cid = pdf["cid"].astype("int64").tolist()
        par = {c: (None if pd.isna(p) else int(p)) for c, p in zip(cid, pdf["parent"])}
        stab = dict(zip(cid, pdf["stab"].astype(float)))
        kids: dict = {c: [] for c in cid}
        for c, p in par.items():
            if p is not None:
                kids[p].append(c)
        eff, sel = dict(stab), {}
        for c in sorted(cid):                      # creation order: children before parents
            if c == root_cid:
                continue
            sub = sum(eff[k] for k in kids[c])
            if kids[c] and sub > stab[c]:
                sel[c], eff[c] = False, sub
            else:
                sel[c] = True
        target: dict = {root_cid: None}
        final: dict = {}
        for c in sorted(cid, reverse=True):        # parents before children
            if c == root_cid:
                continue
            up = target.get(par[c]) if par[c] is not None else None
            final[c] = sel[c] and up is None
            target[c] = up if up is not None else (c if final[c] else None)
        out = [c for c in cid if c != root_cid]
        return pd.DataFrame({"cid": pd.array(out, dtype="Int64"),
                             "selected": pd.Series([final[c] for c in out], dtype=bool),
                             "target": pd.array([target[c] for c in out], dtype="Int64")})
    return run


def _stability_nodes(points: DataFrame, clusters: DataFrame, root_cid) -> DataFrame:
    spark = points.sparkSession
    births = clusters.select("cid", F.col("lam").alias("birth")).unionByName(
        spark.createDataFrame([(int(root_cid), 0.0)], "cid long, birth double"))
    rows = points.select(F.col("cid").alias("parent"), "lam", F.lit(1).cast("long").alias("size")) \
        .unionByName(clusters.select("parent", "lam", "size"))
    stab = (rows.join(births.withColumnRenamed("cid", "parent"), "parent")
            .groupBy("parent").agg(F.sum((F.col("lam") - F.col("birth")) * F.col("size")).alias("stab")))
    return cut_lineage(births.select("cid").join(stab.withColumnRenamed("parent", "cid"), "cid", "left")
                       .join(clusters.select("cid", "parent"), "cid", "left")
                       .select("cid", "parent", F.coalesce("stab", F.lit(0.0)).alias("stab")))


def select_and_target(points: DataFrame, clusters: DataFrame, root_cid) -> DataFrame:
    """(cid, selected, target): EOM selection and, per cluster, the selected cluster on its
    path to the root (NULL = its points are noise).  One bounded task up to TREE_CAP nodes,
    per-level rounds beyond."""
    spark = points.sparkSession
    if root_cid is None:
        return spark.createDataFrame([], "cid long, selected boolean, target long")
    nodes = _stability_nodes(points, clusters, root_cid)
    if nodes.count() <= TREE_CAP:
        return cut_lineage(nodes.groupBy(F.lit(0).alias("__g"))
                           .applyInPandas(_eom_single_task(int(root_cid)), "cid long, selected boolean, target long"))
    sel = select_clusters(points, clusters, root_cid, nodes)
    return sel.join(label_clusters(clusters, sel), "cid", "left")


def label_clusters(clusters: DataFrame, selected: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(cid, target) by pointer jumping: O(log height) rounds."""
    s = selected.select("cid", "selected")
    st = cut_lineage(clusters.select("cid", "parent").join(s, "cid")
                     .select("cid", F.when(F.col("selected"), F.col("cid")).alias("target"),
                             F.when(F.col("selected"), F.lit(None).cast("long")).otherwise(F.col("parent")).alias("nxt")))
    for _ in range(max_rounds):
        if st.where(F.col("target").isNull() & F.col("nxt").isNotNull()).isEmpty():
            break
        j = st.alias("a").join(st.alias("b"), F.col("a.nxt") == F.col("b.cid"), "left")
        st = cut_lineage(j.select(F.col("a.cid").alias("cid"),
                                  F.coalesce(F.col("a.target"), F.col("b.target")).alias("target"),
                                  F.when(F.col("a.target").isNull(), F.col("b.nxt")).alias("nxt")))
    else:
        raise RuntimeError("cluster targets did not settle")
    return st.select("cid", "target")


def select_clusters(points: DataFrame, clusters: DataFrame, root_cid, nodes: DataFrame | None = None,
                    max_rounds: int = 10_000) -> DataFrame:
    """(cid, selected) for every non-root cluster, by per-level rounds (the path for trees
    above TREE_CAP nodes)."""
    spark = points.sparkSession
    if root_cid is None:
        return spark.createDataFrame([], "cid long, selected boolean")
    nodes = _stability_nodes(points, clusters, root_cid) if nodes is None else nodes
    # bottom-up: a node is decided once all its children are decided
    done = spark.createDataFrame([], "cid long, eff double, sel boolean")
    for _ in range(max_rounds):
        pend = nodes.join(done, "cid", "left_anti").where(F.col("cid") != F.lit(int(root_cid)))
        if pend.isEmpty():
            break
        kids = nodes.select(F.col("parent").alias("cid"), F.col("cid").alias("kid")).where(F.col("cid").isNotNull())
        kid_state = kids.join(done.select(F.col("cid").alias("kid"), "eff"), "kid", "left")
        agg = kid_state.groupBy("cid").agg(F.count(F.lit(1)).alias("nk"), F.count("eff").alias("nd"),
                                           F.sum("eff").alias("sub"))
        ready = pend.join(agg, "cid", "left").where(F.col("nk").isNull() | (F.col("nk") == F.col("nd")))
        dec = ready.select("cid", F.when(F.col("nk").isNull(), F.col("stab"))
                           .when(F.col("sub") > F.col("stab"), F.col("sub")).otherwise(F.col("stab")).alias("eff"),
                           (F.col("nk").isNull() | (F.col("sub") <= F.col("stab"))).alias("sel"))
        done = cut_lineage(done.unionByName(dec))
    else:
        raise RuntimeError("the cluster tree is deeper than the rounds allowed")
    # top-down: keep a selected node only if no (non-root) ancestor is selected
    state = cut_lineage(nodes.join(done, "cid", "left").select("cid", "parent", F.coalesce("sel", F.lit(False)).alias("sel")))
    cover = cut_lineage(state.where(F.col("cid") == F.lit(int(root_cid))).select("cid", F.lit(False).alias("anc")))
    for _ in range(max_rounds):
        nxt = (state.join(cover.select(F.col("cid").alias("parent"), F.col("anc").alias("panc")), "parent")
               .join(state.select(F.col("cid").alias("parent"), F.col("sel").alias("psel")), "parent")
               .join(cover.select("cid"), "cid", "left_anti")
               .select("cid", (F.col("panc") | (F.col("psel") & (F.col("parent") != F.lit(int(root_cid))))).alias("anc")))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        cover = cut_lineage(cover.unionByName(nxt))
    else:
        raise RuntimeError("the cluster tree is deeper than the rounds allowed")
    return (state.join(cover, "cid").where(F.col("cid") != F.lit(int(root_cid)))
            .select("cid", (F.col("sel") & ~F.col("anc")).alias("selected")))


# ------------------------------------------------------------------ D5

def spanning_tree(P: DataFrame, n_points: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(u, v, w): the minimum spanning tree of mutual reachability over distinct points (pid, core,
    f0..f3, mult), ties broken on (w, u, v).

    Every edge of it lies in the tree of its own block, or in the tree of the two blocks it joins.  A
    pair of blocks is left out where no edge between them can be in the tree: the two are connected
    within themselves and with one another by edges all lighter than the boxes and the core distances
    allow between them.  Pairs are taken in rounds, those that no known way rules out; while some blocks
    are not connected, the nearest pairs of each connected part."""
    n = P.count() if n_points is None else n_points
    cut = cut_into_blocks(P.select("pid", *FEATS, "core", "mult"), max(TREE_BLOCK, math.ceil(n / BLOCKS_MOST)))
    names, k = cut.block, len(cut.block)
    least_core = np.array([r[0] for r in cut.points.groupBy("block").agg(F.min("core").alias("c"))
                           .orderBy("block").select("c").collect()], float)
    kind = P.schema["pid"].dataType.simpleString()
    schema = f"u {kind}, v {kind}, w double, a int, b int"
    rows = cut.points.select("pid", *FEATS, "core", "block")
    trees = [cut_lineage(rows.withColumn("a", F.col("block")).withColumn("b", F.col("block")).groupBy("a", "b").applyInArrow(_block_tree, schema))]
    place = {int(x): i for i, x in enumerate(names)}
    within = np.zeros(k)                                     # enough to connect the points of a block
    for r in trees[0].groupBy("a").agg(F.max("w").alias("w")).collect():
        within[place[r["a"]]] = r["w"]
    first, second = np.triu_indices(k, 1)
    gap = np.concatenate([np.zeros(0), *(apart(cut.lo[i: i + 1], cut.hi[i: i + 1], cut.lo[i + 1:], cut.hi[i + 1:])[0] for i in range(k))])
    gap = np.maximum(gap, np.maximum(least_core[first], least_core[second]))
    own = np.maximum(within[first], within[second])
    open_, known = np.ones(len(gap), bool), []
    for _ in range(max_rounds):
        way = _minimax(k, known)
        bound = np.maximum(way[first, second], own)
        if np.isinf(way[first, second]).any():               # not connected yet
            part = np.array([int(np.argmax(~np.isinf(way[i]) | (np.arange(k) == i))) for i in range(k)])
            take = np.zeros(len(gap), bool)
            apart_ = np.flatnonzero(open_ & (part[first] != part[second]))
            apart_ = apart_[np.argsort(gap[apart_], kind="stable")]
            for side in (first, second):                     # the nearest pairs of every part
                order = part[side[apart_]]
                seen: dict = {}
                for at, p in zip(apart_.tolist(), order.tolist()):
                    if seen.setdefault(p, 0) < 8:
                        seen[p] += 1
                        take[at] = True
        else:
            take = open_ & (gap <= bound)
        if not take.any():
            break
        open_ &= ~take
        pairs = P.sparkSession.createDataFrame(
            [(int(names[first[i]]), int(names[second[i]]), int(x)) for i in np.flatnonzero(take) for x in (names[first[i]], names[second[i]])],
            "a int, b int, block int")
        # few rows, much work: the planner would put many pairs into one task
        parts = max(1, min(2000, int(take.sum())))
        trees.append(cut_lineage(rows.join(F.broadcast(pairs), "block").repartition(parts, "a", "b").groupBy("a", "b").applyInArrow(_block_tree, schema)))
        for r in trees[-1].groupBy("a", "b").agg(F.min("w").alias("w")).collect():
            a, b = place[r["a"]], place[r["b"]]
            known.append((max(r["w"], within[a], within[b]), a, b))
    else:
        raise RuntimeError(f"no spanning tree within {max_rounds} rounds")
    edges = trees[0]
    for x in trees[1:]:
        edges = edges.unionByName(x)
    if k <= 1:
        return edges.select("u", "v", "w")
    return spanning_forest(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")))


def core_distances(feat: DataFrame, min_samples: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """(distinct points with core distances, Account → pid, accounts)."""
    pts, mapping = distinct_points(feat)
    n = feat.count()
    core = k_distance(pts, min_samples, n).withColumnRenamed("kdist", "core")
    return cut_lineage(pts.join(core, "pid")), cut_lineage(mapping), n


def account_tree(feat: DataFrame, min_samples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(tree over accounts: u, v, w; accounts: acct): distinct points' tree and the copies' star edges."""
    P, mapping, n = core_distances(feat, min_samples)
    star = (mapping.where(F.col("Account") != F.col("pid")).join(P.select("pid", "core"), "pid")
            .select(F.col("pid").alias("u"), F.col("Account").alias("v"), F.col("core").alias("w")))
    return spanning_tree(P, n_points=n).unionByName(star), mapping.select(F.col("Account").alias("acct"))


def hdbscan(feat: DataFrame, min_cluster_size: int = 5, min_samples: int = 3,
            batch_edges: int = BATCH_EDGES) -> DataFrame:
    """Account, hdbscan_cluster (NULL = noise), hdbscan_outlier."""
    tree, accts = account_tree(feat, min_samples)
    points, clusters, root_cid = condense(cut_lineage(tree), accts, min_cluster_size, batch_edges)
    tgt = select_and_target(points, clusters, root_cid)
    labels = points.join(tgt.select("cid", F.col("target").alias("cluster")), "cid").where(F.col("cluster").isNotNull())
    return (accts.join(labels.select("acct", "cluster"), "acct", "left")
            .select(F.col("acct").alias("Account"), F.col("cluster").alias("hdbscan_cluster"),
                    F.col("cluster").isNull().cast("int").alias("hdbscan_outlier")))
