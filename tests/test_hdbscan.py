"""Distributed HDBSCAN against a sequential reference (Prim tree + union-find condensation + EOM)."""
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa

from tests.hdbscan_reference import hdbscan_ref, hdbscan_topdown
from acctlens.operators.hdbscan import hdbscan


def _frame(spark, X):
    pdf = pd.DataFrame(X, columns=["f0", "f1", "f2", "f3"])
    pdf.insert(0, "Account", [f"a{i:04d}" for i in range(len(X))])
    return pdf, spark.createDataFrame(pdf)


def _partition(labels):
    groups = defaultdict(set)
    for i, g in enumerate(labels):
        if g is not None and not (isinstance(g, float) and np.isnan(g)) and g != -1:
            groups[g].add(i)
    return sorted(sorted(v) for v in groups.values())


def test_clusters_and_noise_match_reference_with_copies_and_batches(spark):
    rng = np.random.default_rng(11)
    X = np.vstack([rng.normal(0, 1, (50, 4)), rng.normal(5, 0.5, (20, 4)), rng.uniform(-9, 9, (5, 4)),
                   np.tile([[-4.0, -4.0, 4.0, 4.0]], (6, 1))])       # six identical accounts
    pdf, df = _frame(spark, X)
    got = hdbscan(df, 5, 3, batch_edges=30).toPandas().set_index("Account").loc[pdf.Account]
    ref = hdbscan_ref(X, 5, 3)
    assert np.array_equal(got.hdbscan_outlier.values == 1, ref == -1)
    assert _partition(list(got.hdbscan_cluster.values)) == _partition(list(ref))


def test_single_blob_is_all_noise(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(0, 1, (12, 4))
    pdf, df = _frame(spark, X)
    got = hdbscan(df, 5, 3).toPandas()
    ref = hdbscan_ref(X, 5, 3)
    assert np.array_equal(got.set_index("Account").loc[pdf.Account].hdbscan_outlier.values == 1, ref == -1)


def test_round_based_tree_path_agrees(spark, monkeypatch):
    import acctlens.operators.hdbscan as H
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (30, 4)), rng.normal(6, 0.4, (15, 4)), rng.normal(-6, 0.4, (12, 4))])
    pdf, df = _frame(spark, X)
    monkeypatch.setattr(H, "TREE_CAP", 0)
    got = hdbscan(df, 5, 3).toPandas().set_index("Account").loc[pdf.Account]
    ref = hdbscan_ref(X, 5, 3)
    assert np.array_equal(got.hdbscan_outlier.values == 1, ref == -1)
    assert _partition(list(got.hdbscan_cluster.values)) == _partition(list(ref))


def test_matches_the_definition_taken_top_down(spark, monkeypatch):
    """Against components of the full distance matrix at every threshold, with the distributed rounds
    for the tree (no edge set fits one task)."""
    import acctlens.functions.components as C
    import acctlens.operators.hdbscan as H
    monkeypatch.setattr(H, "ONE_TASK", 0)
    monkeypatch.setattr(C, "ONE_TASK", 0)
    rng = np.random.default_rng(21)
    X = np.vstack([rng.normal(0, 1, (18, 4)), rng.normal(5, 0.5, (12, 4)), rng.normal((-6, 0, 6, 0), 0.7, (9, 4)), rng.uniform(-9, 9, (4, 4))])
    pdf, df = _frame(spark, X)
    got = hdbscan(df, 5, 3).toPandas().set_index("Account").loc[pdf.Account]
    ref = hdbscan_topdown(X, 5, 3)
    assert np.array_equal(got.hdbscan_outlier.values == 1, ref == -1)
    assert _partition(list(got.hdbscan_cluster.values)) == _partition(list(ref))
    assert _partition(list(hdbscan_ref(X, 5, 3))) == _partition(list(ref))


def test_tree_of_near_copies_by_blocks(spark, monkeypatch):
    """Many blocks, points that differ by rounding noise only, and exact ties: the tree on (w, u, v), edge for edge;
    no pairs of blocks beyond those that may hold an edge."""
    import acctlens.operators.hdbscan as H
    rng = np.random.default_rng(17)
    X = np.repeat(rng.normal(0, 1, (12, 4)), 25, axis=0) + rng.integers(-3, 4, (300, 4)) * 3e-14
    X = np.vstack([X, rng.integers(0, 3, (60, 4)) + 20.0, [[90.0] * 4]])
    pdf, df = _frame(spark, X)
    P, _, _ = H.core_distances(df, 3)
    want = H._kruskal(pa.Table.from_pandas(_edges(P.toPandas())).to_batches())
    want = pa.Table.from_batches(want).to_pandas().sort_values(["u", "v"], ignore_index=True)
    for size in (20, 1024):
        monkeypatch.setattr(H, "TREE_BLOCK", size)
        got = H.spanning_tree(P).toPandas().sort_values(["u", "v"], ignore_index=True)
        assert got[["u", "v", "w"]].equals(want[["u", "v", "w"]])


def _edges(p):
    p = p.sort_values("pid", ignore_index=True)
    x, core, name = p[["f0", "f1", "f2", "f3"]].to_numpy(), p.core.to_numpy(), p.pid.to_numpy()
    u, v = np.triu_indices(len(p), 1)
    d = (x[u] - x[v]) ** 2
    w = np.maximum(np.maximum(core[u], core[v]), np.sqrt(d[:, 0] + d[:, 1] + d[:, 2] + d[:, 3]))
    return pd.DataFrame({"u": name[u], "v": name[v], "w": w, "cu": name[u], "cv": name[v]})
