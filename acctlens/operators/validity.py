"""Density-based cluster validity (D8), for choosing between clusterings.

Per cluster: the all-points core distance of each member (a power mean of its distances to all
other members, with the number of features as exponent); the minimum spanning tree of mutual
reachability under these distances, unique by breaking ties on (w, u, v); its sparseness (longest edge between inner nodes, those with
more than one tree edge) and its separation (least mutual reachability from its inner nodes to
another cluster's).  Validity of a cluster = (separation - sparseness) / the larger of them; the score
is the mean over all accounts, noise counting 0.

Identical accounts of a cluster are one point with a multiplicity; the copies hang off their least name by
edges of weight 0.  A cluster of at most ``WHOLE`` times ``TILE`` points is one group of one task, which takes its core
distances and its tree.  The core distance needs every pair of a cluster, so the work is quadratic in
cluster size by the definition; it is asked for explicitly (``DetectSpec.use_validity``).  Larger clusters
are dealt into panels, one group takes one pair of panels chunk by chunk with numpy, and passes on a row
per point, never pairs.  The tree of such clusters grows in Borůvka rounds over blocks of the space: a
component's own blocks and the boxes of the others bound its least edge, and only blocks that come as near
are asked.  Most first edges weigh a point's own core distance and tie; the least name wins, so
about ``LOW`` times ``TILE`` least names of a cluster are compared with every point first.  The separation crosses
clusters and goes by blocks in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from acctlens.functions.components import component_roots
from acctlens.operators.hdbscan import _prim
from acctlens.operators.neighbors import FEATS, _chunks, _rows, cut_into_blocks, distances, least, most
from acctlens.session import cut_lineage

TILE = 1024
WHOLE = 16          # times TILE points of a cluster that one task takes whole
PANELS = 16         # panels of a larger cluster, of TILE to PANELS * TILE points; more beyond
LOW = 4             # times TILE least names of a larger cluster, about


def _spread(n: int) -> int:
    """Partitions for ``n`` accounts to be compared: the work is large where the rows are few."""
    return max(1, min(2000, math.ceil(4 * n / TILE)))


def _inverse_sums(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the sum over ``y`` of multiplicity / distance to the power of the features, and for
    each row of ``y`` that over ``x``.  ``same``: the two are one table, and the first is all."""
    sx, sy = np.zeros(len(x)), np.zeros(len(y))
    d, e = np.empty((256, 256)), np.empty((256, 256))
    for i in _chunks(len(x)):
        for j in _chunks(len(y)):
            if same and j.start < i.start:
                continue
            u, v = x[i], y[j]
            s, t = d[: len(u), : len(v)], e[: len(u), : len(v)]
            np.subtract(u[:, None, 0], v[None, :, 0], out=s)
            np.multiply(s, s, out=s)
            for k in range(1, len(FEATS)):
                np.subtract(u[:, None, k], v[None, :, k], out=t)
                np.multiply(t, t, out=t)
                np.add(s, t, out=s)
            with np.errstate(divide="ignore", over="ignore"):
                np.divide(1.0, s ** (len(FEATS) // 2), out=s)
            if same and i.start == j.start:
                np.fill_diagonal(s, 0.0)
                sx[i] += s @ my[j]
                continue
            sx[i] += s @ my[j]
            other = mx[i] @ s
            if same:
                sx[j] += other
            else:
                sy[j] += other
    return sx, sy


def _core(s: np.ndarray, mult: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Core distances from the sums: 0 for a copy, and for an account alone in its cluster."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / (size - 1)
        return np.where((mult > 1) | (size <= 1) | (mean == np.inf), 0.0, mean ** (-1.0 / len(FEATS)))


def _whole(t: pa.Table) -> pa.Table:
    """One cluster: the points that count for its separation, with their core distances, and its sparseness."""
    t = t.sort_by("pid")
    x, mult, size = _rows(t), t.column("mult").to_numpy(), t.column("size").to_numpy()
    core = _core(_inverse_sums(x, x, mult.astype(float), mult.astype(float), True)[0], mult, size)
    u, v, w = _prim(x, core)
    inner = np.bincount(u, minlength=len(x)) + np.bincount(v, minlength=len(x)) + mult - 1 > 1
    longest = w[inner[u] & inner[v]]
    sparse = longest.max() if len(longest) else w.max(initial=0.0)
    t = t.select(["pid", "cluster", *FEATS]).append_column("core", pa.array(core, pa.float64()))
    t = t.append_column("sparseness", pa.array(np.full(len(x), sparse), pa.float64()))
    return t.filter(pa.array(inner if inner.any() else np.ones(len(x), bool)))


def _panel_sums(t: pa.Table) -> pa.Table:
    panel, a, b = t.column("panel").to_numpy(), t.column("a")[0].as_py(), t.column("b")[0].as_py()
    x, mult, at = _rows(t), t.column("mult").to_numpy().astype(float), (np.flatnonzero(panel == a), np.flatnonzero(panel == b))
    s = np.zeros(len(x))
    if a == b:
        s[at[0]] = _inverse_sums(x, x, mult, mult, True)[0]
    else:
        s[at[0]], s[at[1]] = _inverse_sums(x[at[0]], x[at[1]], mult[at[0]], mult[at[1]], False)
    return pa.table({"pid": t.column("pid"), "s": pa.array(s, pa.float64())})


def _panels(held: Column) -> Column:
    return F.greatest(F.ceil(held / (PANELS * TILE)), F.least(F.ceil(held / TILE), F.lit(PANELS))).cast("int")


def core_distances(points: DataFrame) -> DataFrame:
    """``points`` (pid, cluster, mult, size, held, f0..f3) with core, by pairs of panels of their cluster."""
    kind = points.schema["pid"].dataType.simpleString()
    n = _panels(F.col("held"))
    pairs = points.groupBy("cluster").agg(F.first("held").alias("held")).agg(F.sum(n * (n + 1) / 2)).first()[0]
    parts = max(1, min(2000, int(pairs or 1)))
    mine = F.pmod(F.xxhash64("pid"), n).cast("int")
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(F.col("panel"), o).alias("a"), F.greatest(F.col("panel"), o).alias("b")))
    dealt = points.withColumn("panel", mine).withColumn("pair", F.explode(every)).select("cluster", "pid", "mult", *FEATS, "panel", "pair.a", "pair.b")
    sums = (dealt.repartition(parts, "cluster", "a", "b").groupBy("cluster", "a", "b").applyInArrow(_panel_sums, f"pid {kind}, s double")
            .groupBy("pid").agg(F.sum("s").alias("s")))
    mean = F.col("s") / (F.col("size") - 1)
    core = F.when((F.col("mult") > 1) | (mean == float("inf")), 0.0).otherwise(mean ** (-1.0 / len(FEATS)))
    # the planner sizes the sums by the points' files
    return points.join(sums.hint("merge"), "pid").withColumn("core", core).drop("s")


def _least_edges(here: pa.Table, there: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``here`` the least edge to another component's row of ``there``, which is in the order of
    names and has the same cluster: weight (inf: none) and place."""
    code, _ = pd.factorize(np.array(here.column("comp").to_pylist() + there.column("comp").to_pylist(), object))
    x, y, mine, other = _rows(here), _rows(there), code[: here.num_rows], code[here.num_rows:]
    core, far = here.column("core").to_numpy(), there.column("core").to_numpy()
    w, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for part in _chunks(len(x) if len(y) else 0):
        d = np.maximum(np.maximum(core[part, None], far[None]), distances(x[part], y))
        d[mine[part, None] == other[None]] = np.inf
        at[part] = d.argmin(axis=1)
        w[part] = d[np.arange(len(d)), at[part]]
    return w, at


def least_names(rows: DataFrame) -> DataFrame:
    """The rows (pid, cluster, ...) of about ``LOW * TILE`` least names of each cluster.  How many they are comes from
    64 * ``TILE`` names drawn by hash, which matters for the work alone: none below the last is left out."""
    share = F.least(F.lit(1.0), F.lit(64.0 * TILE) / F.col("held"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("held"))
    drawn = rows.select("cluster", "pid").join(sizes, "cluster").where(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < share * F.lit(1 << 30))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("pid"))
    last = drawn.withColumn("place", place).where(F.col("place") <= F.ceil(share * F.lit(LOW * TILE))).groupBy("cluster").agg(F.max("pid").alias("last"))
    return rows.join(last, "cluster").where(F.col("pid") <= F.col("last")).drop("last")


def cluster_trees(points: DataFrame, max_rounds: int = 64) -> DataFrame:
    """cluster, u, v, w: the minimum spanning tree of mutual reachability of each cluster over its distinct
    ``points`` (pid, cluster, mult, core, f0..f3), ties broken on (w, u, v)."""
    points = points.select("pid", "cluster", "mult", "core", *FEATS)
    if points.isEmpty():
        return points.select("cluster", F.col("pid").alias("u"), F.col("pid").alias("v"), F.col("core").alias("w"))
    pid, kind = points.schema["pid"].dataType.simpleString(), points.schema["cluster"].dataType.simpleString()
    place, floats = f"cluster {kind}, pid {pid}, comp {pid}", ", ".join(f"{c} double" for c in [*FEATS, "core"])
    edge = f"cluster {kind}, comp {pid}, mate {pid}, w double, u {pid}, v {pid}"
    rows = cut_lineage(cut_into_blocks(points, TILE).points.drop("mult").withColumn("comp", F.col("pid")))
    # blocks by cluster, so a block holds one cluster alone
    low = cut_lineage(rows.select("cluster", "block").distinct().join(least_names(rows).drop("block"), "cluster"))
    active, found = rows.withColumn("active", F.lit(True)), None
    for turn in range(max_rounds):
        held = rows.groupBy("cluster", "block").agg(
            *[F.min(c).alias(f"lo_{c}") for c in FEATS], *[F.max(c).alias(f"hi_{c}") for c in FEATS], F.min("core").alias("low"),
            F.max("core").alias("high"), F.min("pid").alias("name"), F.min("comp").alias("first"), F.max("comp").alias("last")).collect()
        boxes = pd.DataFrame([r.asDict() for r in held])
        lo, hi = (np.ascontiguousarray(boxes[[f"{side}_{c}" for c in FEATS]].to_numpy(float)) for side in ("lo", "hi"))
        nearest_core, farthest_core = boxes["low"].to_numpy(float), boxes["high"].to_numpy(float)
        mixed = (boxes["first"] != boxes["last"]).to_numpy()
        block, least_name = boxes["block"].to_numpy(np.int32), boxes["name"].to_numpy(object)
        clusters, comps = (pd.Index(boxes[c].to_numpy(object)).unique() for c in ("cluster", "first"))
        cluster, only = clusters.get_indexer(boxes["cluster"].to_numpy(object)), comps.get_indexer(boxes["first"].to_numpy(object))
        single = np.where(mixed, -2, only)

        def codes(t) -> tuple[np.ndarray, np.ndarray]:
            return (clusters.get_indexer(np.array(t.column("cluster").to_pylist(), object)), comps.get_indexer(np.array(t.column("comp").to_pylist(), object)))

        def foreign(mine: np.ndarray, comp: np.ndarray) -> np.ndarray:
            """Rows by blocks: the block is of the row's cluster and holds another component."""
            return (mine[:, None] == cluster[None]) & (comp[:, None] != single[None])

        def own(t: pa.Table, also: pa.Table | None = None) -> pa.Table:
            here = t.filter(t.column("active"))
            there = t.select(["pid", "comp", "core", *FEATS])
            if also is not None:
                there = pa.concat_tables([there, also.select(there.column_names)]).combine_chunks()
            there = there.sort_by("pid")
            w, at = _least_edges(here, there)
            x, core = _rows(here), here.column("core").to_numpy()
            name = there.column("pid").take(pa.array(at)).to_pylist()
            mine, none = here.column("pid").to_pylist(), w == np.inf
            bound, (of, comp) = w.copy(), codes(here)
            for part in _chunks(len(x)):
                farthest = np.maximum(np.maximum(core[part, None], farthest_core[None]), most(x[part], lo, hi))
                bound[part] = np.minimum(w[part], np.where(foreign(of[part], comp[part]), farthest, np.inf).min(axis=1))
            # no edge weighs less than the core distance, and all lower names were compared
            last = max(also.column("pid").to_pylist(), default=None) if also is not None else None
            done = np.array([last is not None and q <= last for q in name], bool) & (w == core)
            put = lambda values, kind: pa.array(values, kind, mask=none)
            return here.select(["cluster", "pid", "comp", *FEATS, "core", "block"]).append_column(
                "mate", put(there.column("comp").take(pa.array(at)).to_pylist(), here.schema.field("comp").type)).append_column(
                "w", pa.array(w, pa.float64())).append_column(
                "u", put([min(a, b) for a, b in zip(mine, name)], here.schema.field("pid").type)).append_column(
                "v", put([max(a, b) for a, b in zip(mine, name)], here.schema.field("pid").type)).append_column(
                "bound", pa.array(bound, pa.float64())).append_column("done", pa.array(done))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, core, bound = _rows(b), b.column("core").to_numpy(), b.column("bound").to_numpy()
                _, code = np.unique(np.concatenate([np.array(b.column("pid").to_pylist(), object), least_name,
                                                    np.array([u or "" for u in b.column("u").to_pylist()], object)]), return_inverse=True)
                mine, name, u = code[: len(x)], code[len(x): len(x) + len(block)], code[len(x) + len(block):]
                u = np.where(b.column("u").is_null().to_numpy(zero_copy_only=False), len(code), u)
                away, (of, comp) = b.column("block").to_numpy(), codes(b)
                for part in _chunks(len(x)):
                    nearest = np.maximum(np.maximum(core[part, None], nearest_core[None]), least(x[part], lo, hi))
                    near = (nearest < bound[part, None]) | ((nearest == bound[part, None]) & (np.minimum(mine[part, None], name[None]) <= u[part, None]))
                    row, at = np.nonzero(near & foreign(of[part], comp[part]) & (away[part, None] != block[None]))
                    out = b.select(["cluster", "pid", "comp", *FEATS, "core"]).take(pa.array(row + part.start))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block[at])], names=[*out.schema.names, "block"])

        def other(here: pa.Table, there: pa.Table) -> pa.Table:
            there = there.sort_by("pid")
            w, at = _least_edges(here, there)
            kept = np.flatnonzero(w < np.inf)
            here, w, there = here.take(pa.array(kept)), w[kept], there.take(pa.array(at[kept]))
            ends = [*zip(here.column("pid").to_pylist(), there.column("pid").to_pylist())]
            name = here.schema.field("pid").type
            return pa.table({"cluster": here.column("cluster"), "comp": here.column("comp"), "mate": there.column("comp"), "w": pa.array(w, pa.float64()),
                             "u": pa.array([min(e) for e in ends], name), "v": pa.array([max(e) for e in ends], name)})

        parts = max(1, min(2000, len(boxes)))
        blocks = rows.repartition(parts, "cluster", "block").groupBy("cluster", "block")
        mine = active.repartition(parts, "cluster", "block").groupBy("cluster", "block")
        schema = f"{place}, {floats}, block int, mate {pid}, w double, u {pid}, v {pid}, bound double, done boolean"
        first = cut_lineage(mine.cogroup(low.repartition(parts, "cluster", "block").groupBy("cluster", "block")).applyInArrow(own, schema)
                            if turn == 0 else mine.applyInArrow(lambda t: own(t), schema))
        # of equal bounds, that without a name is the least
        bounds = first.where(~F.col("done")).groupBy("comp").agg(F.min(F.struct("bound", F.when(F.col("bound") == F.col("w"), F.col("u")).alias("u"))).alias("b"))
        asked = first.where(~F.col("done")).select("cluster", "pid", "comp", *FEATS, "core", "block").join(bounds.select("comp", "b.*"), "comp")
        asked = asked.mapInArrow(ask, f"{place}, {floats}, block int").repartition(parts, "cluster", "block").groupBy("cluster", "block")
        more = asked.cogroup(blocks).applyInArrow(other, edge)
        ways = first.where(F.col("w") < float("inf")).select("cluster", "comp", "mate", "w", "u", "v").unionByName(more)
        least_ = cut_lineage(ways.groupBy("cluster", "comp").agg(F.min(F.struct("w", "u", "v", "mate")).alias("e")).select("cluster", "comp", "e.*"))
        found = least_.drop("comp", "mate") if found is None else found.unionByName(least_.drop("comp", "mate"))
        roots = component_roots(least_.select(F.col("comp").alias("a"), F.col("mate").alias("b")))
        rows = cut_lineage(rows.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))
        sizes = rows.groupBy("cluster", "comp").agg(F.count("*").alias("n")).groupBy("cluster").agg(
            F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"))
        tops = cut_lineage(sizes.where(F.col("comps") > 1).select("cluster", F.col("top.comp").alias("top")))
        if tops.isEmpty():
            return cut_lineage(found.distinct())
        # the largest component of a cluster is met by the others, and does not ask
        active = rows.join(tops, "cluster", "left").withColumn("active", F.coalesce(F.col("comp") != F.col("top"), F.lit(False))).drop("top")
    raise RuntimeError(f"no spanning trees within {max_rounds} rounds")


def _nearest_other(t: pa.Table, among: pa.Table) -> np.ndarray:
    """For each row of ``t`` the least mutual reachability to another cluster's row of ``among`` (inf: none)."""
    code, _ = pd.factorize(np.array(t.column("cluster").to_pylist() + among.column("cluster").to_pylist(), object))
    x, y, mine, other = _rows(t), _rows(among), code[: t.num_rows], code[t.num_rows:]
    core, there = t.column("core").to_numpy(), among.column("core").to_numpy()
    w = np.full(len(x), np.inf)
    for part in _chunks(len(x) if len(y) else 0):
        d = np.maximum(np.maximum(core[part, None], there[None]), distances(x[part], y))
        w[part] = np.where(mine[part, None] == other[None], np.inf, d).min(axis=1)
    return w


def separations(inside: DataFrame) -> DataFrame:
    """cluster, separation: the least mutual reachability between accounts (Account, cluster, core, f0..f3) of the
    cluster and of others.  No row for a cluster that is the only one."""
    kind = inside.schema["cluster"].dataType.simpleString()
    points = cut_lineage(inside.groupBy("cluster", *FEATS).agg(F.min("core").alias("core"), F.min("Account").alias("pid"), F.count("*").alias("mult")))
    cut = cut_into_blocks(points, TILE)
    names, lo, hi = cut.block, cut.lo, cut.hi
    held = cut.points.groupBy("block").agg(F.min("core").alias("low"), F.max("core").alias("high"), F.min("cluster").alias("first"),
                                           F.max("cluster").alias("last")).orderBy("block").collect()
    low, high = np.array([r["low"] for r in held], float), np.array([r["high"] for r in held], float)
    mixed = np.array([r["first"] != r["last"] for r in held], bool)
    only = [r["first"] for r in held]

    def foreign(clusters: list) -> np.ndarray:
        """Rows by blocks: the block holds another cluster."""
        code, values = pd.factorize(np.array(clusters, object))
        return (mixed[None] | (pd.Index(values, dtype=object).get_indexer(pd.Index(only, dtype=object))[None] != np.arange(len(values))[:, None]))[code]

    def own(t: pa.Table) -> pa.Table:
        x, core, others = _rows(t), t.column("core").to_numpy(), foreign(t.column("cluster").to_pylist())
        w = _nearest_other(t, t)
        bound = w.copy()
        for part in _chunks(len(x)):
            farthest = np.maximum(np.maximum(core[part, None], high[None]), most(x[part], lo, hi))
            bound[part] = np.minimum(w[part], np.where(others[part], farthest, np.inf).min(axis=1))
        return t.select(["cluster", *FEATS, "core", "block"]).append_column("w", pa.array(w)).append_column("bound", pa.array(bound))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, core, bound = _rows(b), b.column("core").to_numpy(), b.column("bound").to_numpy()
            others = foreign(b.column("cluster").to_pylist()) & (b.column("block").to_numpy()[:, None] != names[None])
            for part in _chunks(len(x)):
                nearest = np.maximum(np.maximum(core[part, None], low[None]), least(x[part], lo, hi))
                row, at = np.nonzero(others[part] & (nearest <= bound[part, None]))
                rows = b.select(["cluster", *FEATS, "core"]).take(pa.array(row + part.start))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[at].astype(np.int32))], names=[*rows.schema.names, "block"])

    def other(here: pa.Table, there: pa.Table) -> pa.Table:
        return pa.table({"cluster": here.column("cluster"), "w": pa.array(_nearest_other(here, there), pa.float64())})

    floats = ", ".join(f"{c} double" for c in [*FEATS, "core"])
    parts = _spread(len(names) * TILE)
    blocks = cut.points.repartition(parts, "block").groupBy("block")
    first = cut_lineage(blocks.applyInArrow(own, f"cluster {kind}, {floats}, block int, w double, bound double"))
    bounds = first.groupBy("cluster").agg(F.min("bound").alias("bound")).where(F.col("bound") < float("inf"))
    asked = first.drop("w", "bound").join(bounds, "cluster").select("cluster", *FEATS, "core", "block", "bound")
    asked = asked.mapInArrow(ask, f"cluster {kind}, {floats}, block int").repartition(parts, "block").groupBy("block")
    more = asked.cogroup(blocks).applyInArrow(other, f"cluster {kind}, w double")
    return first.select("cluster", "w").unionByName(more).where(F.col("w") < float("inf")).groupBy("cluster").agg(F.min("w").alias("separation"))


def cluster_validity(feat: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, size, sparseness, separation, validity of each cluster; ``labels``: Account, cluster
    (NULL: noise).  A single cluster has a NULL separation; one of a single account sparseness 0."""
    rows = feat.join(labels.where(F.col("cluster").isNotNull()).select("Account", "cluster"), "Account")
    points = cut_lineage(rows.groupBy("cluster", *FEATS).agg(F.min("Account").alias("pid"), F.count("*").alias("mult")))
    sizes = cut_lineage(points.groupBy("cluster").agg(F.sum("mult").alias("size"), F.count("*").alias("held")))
    points = cut_lineage(points.join(sizes, "cluster"))
    kind = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("pid", "cluster"))
    few = points.where(F.col("held") <= WHOLE * TILE)
    parts = max(1, min(2000, math.ceil(few.count() / (2 * TILE))))
    whole = cut_lineage(few.repartition(parts, "cluster").groupBy("cluster").applyInArrow(
        _whole, kind + ", " + ", ".join(f"{c} double" for c in [*FEATS, "core", "sparseness"])))
    many = points.where(F.col("held") > WHOLE * TILE)
    sparse, inside = whole.groupBy("cluster").agg(F.max("sparseness").alias("sparseness")), whole.drop("sparseness")
    if not many.isEmpty():
        many = cut_lineage(core_distances(many))
        tree = cluster_trees(many)
        ends = tree.select(F.col("u").alias("pid")).union(tree.select(F.col("v").alias("pid"))).groupBy("pid").agg(F.count("*").alias("degree"))
        inner = cut_lineage(many.join(ends, "pid").where(F.col("degree") + F.col("mult") > 2).select("pid", "cluster", *FEATS, "core"))
        spans = (tree.join(inner.select(F.col("pid").alias("u"), F.lit(1).alias("iu")), "u", "left")
                 .join(inner.select(F.col("pid").alias("v"), F.lit(1).alias("iv")), "v", "left"))
        # a tree of three points or more has an inner one
        sparse = sparse.unionByName(spans.groupBy("cluster").agg(F.coalesce(
            F.max(F.when(F.col("iu").isNotNull() & F.col("iv").isNotNull(), F.col("w"))), F.max("w")).alias("sparseness")))
        inside = inside.unionByName(inner)
    inside = cut_lineage(inside.withColumnRenamed("pid", "Account"))
    apart = separations(inside)
    out = sizes.drop("held").join(sparse, "cluster", "left").join(apart, "cluster", "left").withColumn("sparseness", F.coalesce("sparseness", F.lit(0.0)))
    larger = F.greatest("separation", "sparseness")
    return out.select("cluster", "size", "sparseness", "separation", F.when(
        F.col("separation").isNotNull(), F.when(larger > 0, (F.col("separation") - F.col("sparseness")) / larger).otherwise(F.lit(0.0))).alias("validity"))


def validity(feat: DataFrame, labels: DataFrame) -> float | None:
    """The score of a clustering; None with fewer than two clusters."""
    per = cut_lineage(cluster_validity(feat, labels))
    n = feat.count()
    row = per.agg(F.count("*").alias("k"), (F.sum(F.col("size") * F.col("validity")) / F.lit(n)).alias("score")).first()
    return float(row["score"]) if row["k"] >= 2 else None
