"""DBSCAN by dense cells against all pairs."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acctlens.operators import density as DN
from acctlens.operators import neighbors as NB

FEATS = ["f0", "f1", "f2", "f3"]


def frame(x):
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf.insert(0, "Account", [f"a{i:06d}" for i in range(len(x))])
    return pdf


def plain(x, eps, min_samples):
    near = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_samples
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(1), len(x))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None, :], label[None, :], len(x)).min(1)
    return near.sum(1), core, np.where(core, label, border)


def plates(gap):
    """Two plates of many points, ``gap`` apart along one axis."""
    rng = np.random.default_rng(5)
    a = np.column_stack([rng.uniform(0, 0.4, 250), np.zeros(250), rng.uniform(0, 0.4, 250), np.zeros(250)])
    b = a[::-1].copy()
    b[:, 3] = gap
    return np.vstack([a, b])


def blobs():
    rng = np.random.default_rng(11)
    return np.vstack([rng.normal(0, 1, (250, 4)), rng.normal(4, 0.1, (150, 4)), rng.normal([4.9, 4, 4, 4], 0.1, (100, 4)),
                      np.tile([[-3.0, 2.0, 2.0, -2.0]], (9, 1)), [[-3.5, 2.0, 2.0, -2.0]], rng.uniform(-6, 6, (40, 4))])


@pytest.mark.parametrize("x, eps, min_samples", [
    (blobs(), 0.5, 5), (blobs(), 1.0, 4), (blobs(), 0.2, 3), (plates(1.0), 1.0, 5), (plates(1.0 + 1e-9), 1.0, 5)])
@pytest.mark.parametrize("direct", [DN.DIRECT, 1])
def test_cells_equal_all_pairs(spark, monkeypatch, x, eps, min_samples, direct):
    monkeypatch.setattr(DN, "DIRECT", direct)
    pdf = frame(x)
    n, core, label = plain(x, eps, min_samples)
    res = DN.dbscan(spark.createDataFrame(pdf), 5, 90, min_samples, eps)
    got = (res.flags.join(DN.within_counts(res), "Account").join(DN.cluster_labels(res), "Account").toPandas()
           .set_index("Account").loc[pdf.Account])
    assert res.points.where("dense").count() > 0
    assert (got.n_within.to_numpy() == n).all() and (got.is_core.to_numpy() == core).all()
    assert (got.dbscan_outlier.to_numpy() == (label == len(x))).all()
    # copies of one vector are one point under the smallest name, so labels are compared by name
    assert got.cluster.where(got.cluster.notna(), None).tolist() == [None if v == len(x) else pdf.Account[v] for v in label]


def test_dense_blob_forms_no_quadratic_pairs(spark):
    n = 200_000
    draw = lambda i: F.randn(100 + i) if i != 1 else F.col("f0")
    feat = spark.range(n, numPartitions=8).select(F.format_string("a%06d", "id").alias("Account"), F.randn(100).alias("f0"), "id")
    feat = feat.select("Account", "f0", F.col("f0").alias("f1"), draw(2).alias("f2"), draw(3).alias("f3"))
    t = time.time()
    res = DN.dbscan(feat, 5, 90, 5, 0.5)
    links, labels = res.links.agg(F.sum("n")).first()[0], DN.cluster_labels(res)
    assert labels.where("cluster is not null").select("cluster").distinct().count() >= 1
    # about 30 % of all points lie within 0.5 of a point in the middle: some 10**9 pairs in all
    assert links < 100 * n
    assert time.time() - t < 240


@pytest.mark.parametrize("query, of", [("d3_dbscan_noise", "dbscan_of"), ("d3_dbscan_noise_customers", "customers_dbscan_of")])
def test_noise_queries_count_every_pair_within_eps(spark, monkeypatch, query, of):
    from acctlens.plans import queries as Q
    pdf = frame(blobs())
    n, _, label = plain(blobs(), 0.5, 5)
    res = DN.dbscan(spark.createDataFrame(pdf), 5, 90, 5, 0.5)
    monkeypatch.setattr(Q, of, lambda spark, d: res)
    run, sql = Q.REGISTRY[query]
    got = run(spark, "").toPandas().set_index("Account").loc[pdf.Account]
    assert (got.n_within.to_numpy() == n).all() and (got.dbscan_outlier.to_numpy() == (label == len(n))).all()
    assert "n_within" in sql[-350:]


def near_copies(base, copies):
    """Groups of points that differ by rounding noise only."""
    rng = np.random.default_rng(9)
    return np.repeat(rng.normal(0, 1, (base, 4)), copies, axis=0) + rng.integers(-3, 4, (base * copies, 4)) * 3e-14


def sums(x, y):
    d = [x[:, None, i] - y[None, :, i] for i in range(4)]
    return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + d[3] * d[3])


@pytest.mark.parametrize("size", [4, 50, 1024])
@pytest.mark.parametrize("x", [near_copies(8, 40), blobs(), np.vstack([near_copies(3, 60), np.full((1, 4), 50.0)])])
def test_blocks_equal_all_pairs(spark, monkeypatch, x, size):
    """Exact k-distances and counts, also where points lie within rounding noise of one another."""
    monkeypatch.setattr(NB, "BLOCK", size)
    pdf = frame(x)
    pts, mapping = NB.distinct_points(spark.createDataFrame(pdf))
    d = np.sort(sums(x, x), axis=1)
    got = mapping.join(NB.k_distance(pts, 5), "pid").toPandas().set_index("Account").loc[pdf.Account]
    assert (got.kdist.to_numpy() == d[:, 4]).all()
    for r in (1e-13, 0.7):
        n = mapping.join(NB.counts_within(pts, r), "pid").toPandas().set_index("Account").loc[pdf.Account].n
        assert (n.to_numpy() == (d <= r).sum(1)).all()


def test_blocks_hold_few_points_however_close(spark):
    x = near_copies(6, 500)
    cut = NB.cut_into_blocks(NB.distinct_points(spark.createDataFrame(frame(x)))[0], 100)
    assert cut.points.groupBy("block").count().agg({"count": "max"}).first()[0] < 200
