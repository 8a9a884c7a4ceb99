import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acctlens.operators import decide as DC
from acctlens.operators import density as DN
from acctlens.operators import residuals as RS
from acctlens.settings import DetectSpec


def test_reference_aggregation_fixture(spark):
    df = spark.createDataFrame(list(zip(["A1", "A1", "A1", "A2", "A2", "A3"], [.1, .2, .15, .5, .6, -.3],
                                        [100., 200., 150., 300., 200., 100.])), "account string, residual double, weight double")
    st = {r.Account: r for r in RS.account_stats(df).collect()}
    assert len(st) == 3
    assert st["A1"].w_mean_residual == pytest.approx((10 + 40 + 22.5) / 450)
    assert st["A3"].w_std_residual == 0.0 and st["A3"].w_skew_residual == 0.0 and st["A3"]["count"] == 1
    fm = RS.feature_matrix(RS.account_stats(df)).toPandas()
    for c in ["f0", "f1", "f2", "f3"]:
        assert abs(fm[c].mean()) < 1e-9
        assert fm[c].std(ddof=0) == pytest.approx(1.0) or fm[c].abs().max() < 1e-9


def test_null_weight_and_zero_weights(spark):
    df = spark.createDataFrame([("A", 1.0, None), ("A", 3.0, 1.0), (None, 5.0, 1.0)], "account string, residual double, weight double")
    st = RS.account_stats(df).collect()
    assert len(st) == 1 and st[0].w_mean_residual == 2.0
    z = spark.createDataFrame([("A", 1.0, 0.0)], "account string, residual double, weight double")
    with pytest.raises(Exception, match="Weights sum to zero"):
        RS.account_stats(z).collect()


def test_mad_with_hot_account_path(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"account": ["hot"] * 5001 + ["b"] * 30, "residual": rng.normal(size=5031), "weight": 1.0})
    st = {r.Account: r.mad_residual for r in RS.account_stats(spark.createDataFrame(pdf), median_cap=200).collect()}
    for a, g in pdf.groupby("account"):
        v = g.residual.values
        assert st[a] == pytest.approx(np.median(np.abs(v - np.median(v))), abs=1e-12)


def _brute_kdist(X, k):
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, k - 1]


def test_grid_kdistance_and_dbscan_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(0, 1, (120, 4)), rng.normal(6, 0.3, (30, 4)), np.tile([[2.0, 2.0, 2.0, 2.0]], (8, 1))])
    pdf = pd.DataFrame(X, columns=["f0", "f1", "f2", "f3"])
    pdf.insert(0, "Account", [f"a{i:04d}" for i in range(len(X))])
    feat = spark.createDataFrame(pdf)
    res = DN.dbscan(feat, k=5, eps_percentile=90, min_samples=5)
    kd = _brute_kdist(X, 5)
    got = res.flags.toPandas().set_index("Account").loc[pdf.Account]
    assert np.allclose(got.kdist.values, kd, atol=1e-12)
    eps = np.percentile(kd, 90)
    assert res.eps == pytest.approx(eps, abs=1e-12)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= 5
    noise = ~core & ~((d <= eps) & core[None, :]).any(1)
    assert np.array_equal(got.dbscan_outlier.values == 1, noise)


def test_dbscan_errors_and_boundary(spark):
    few = spark.createDataFrame([(f"a{i}", float(i), 0.0, 0.0, 0.0) for i in range(4)], "Account string, f0 double, f1 double, f2 double, f3 double")
    with pytest.raises(ValueError, match="n_neighbors"):
        DN.dbscan(few, k=5)
    same = spark.createDataFrame([(f"a{i}", 1.0, 1.0, 1.0, 1.0) for i in range(6)], "Account string, f0 double, f1 double, f2 double, f3 double")
    with pytest.raises(ValueError, match="eps must be > 0"):
        DN.dbscan(same, k=5)
    # five points at the origin are core; a point at exactly eps from them is a border point, not noise
    pts = [(f"c{i}", 0.0, 0.0, 0.0, 0.0) for i in range(5)] + [("edge", 1.0, 0.0, 0.0, 0.0), ("far", 9.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "Account string, f0 double, f1 double, f2 double, f3 double")
    flags = {r.Account: r.dbscan_outlier for r in DN.dbscan(df, k=5, min_samples=5, eps=1.0).flags.collect()}
    assert flags["edge"] == 0 and flags["far"] == 1 and flags["c0"] == 0


def test_density_choice_and_combination(spark):
    cases = [((3, None, False, None, None), "DBSCAN"), ((3, 2, False, None, None), "HDBSCAN"), ((3, 0, False, 0.1, 0.9), "DBSCAN"),
             ((1, 1, True, None, None), "DBSCAN"), ((1, 1, True, 0.5, 0.5), "HDBSCAN"), ((1, 1, True, 0.6, 0.5), "DBSCAN"),
             ((1, 0, True, None, 0.2), "HDBSCAN"), ((1, 1, True, 0.2, None), "DBSCAN")]
    df = spark.createDataFrame([c for c, _ in cases], "d long, h long, ok boolean, sd double, sh double")
    assert [r.m for r in df.select(DC.choice(df.d, df.h, df.ok, df.sd, df.sh).alias("m")).collect()] == [m for _, m in cases]
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "d int, f int")
    flag, typ = DC.combine(df.d, df.f, "DBSCAN")
    got = [(r.flag, r.t) for r in df.select(flag.alias("flag"), typ.alias("t")).collect()]
    assert got == [(1, "both"), (1, "dbscan_only"), (1, "iforest_only"), (0, "normal")]


def test_isolation_forest_finds_planted_accounts_and_is_deterministic(spark):
    rng = np.random.RandomState(42)
    accounts = [f"A{i:03d}" for i in range(50)]
    shifted = set(rng.choice(accounts, 5, replace=False))
    rows = []
    for a in accounts:
        bias = 3.0 if a in shifted else 0.0
        for r in rng.normal(0, 0.1, 20) + bias * rng.choice([-1, 1]):
            rows.append((a, float(r), float(rng.randint(10, 100))))
    res = spark.createDataFrame(rows, "account string, residual double, weight double")
    det = DC.detect(RS.account_stats(res), DetectSpec())
    acc = det.accounts.toPandas()
    assert 0 < acc.outlier_flag.sum() < 50 and len(acc) == 50
    top = set(acc.sort_values("if_score").Account.head(5))
    assert len(top & shifted) >= 4
    assert shifted <= set(acc[acc.outlier_flag == 1].Account)
    again = DC.detect(RS.account_stats(res), DetectSpec()).accounts.toPandas()
    assert np.allclose(acc.sort_values("Account").if_score.values, again.sort_values("Account").if_score.values)
    meta = det.metadata.first()
    assert meta.combined_outliers == acc.outlier_flag.sum()


def _dbcv(X, labels):
    """The index from a full distance matrix."""
    n, d = X.shape
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    names = sorted(set(labels) - {-1})
    inner, sparse, core = {}, {}, np.zeros(n)
    for c in names:
        i = np.flatnonzero(labels == c)
        for p in i:
            o = i[i != p]
            core[p] = ((1 / D[p, o]) ** d).mean() ** (-1 / d)
        M = np.maximum(np.maximum(core[i][:, None], core[i][None]), D[np.ix_(i, i)])
        part, edges = list(range(len(i))), []
        for w, a, b in sorted((M[a, b], a, b) for b in range(len(i)) for a in range(b)):
            if part[a] != part[b]:
                edges.append((w, a, b))
                part = [part[a] if x == part[b] else x for x in part]
        degree = np.bincount([x for e in edges for x in e[1:]], minlength=len(i))
        long = [w for w, a, b in edges if degree[a] > 1 and degree[b] > 1]
        sparse[c] = max(long or [e[0] for e in edges])
        inner[c] = i[degree > 1] if (degree > 1).any() else i
    score = 0.0
    for c in names:
        sep = min(max(core[p], core[q], D[p, q]) for e in names if e != c for p in inner[c] for q in inner[e])
        score += (labels == c).sum() / n * (sep - sparse[c]) / max(sep, sparse[c])
    return score


@pytest.mark.parametrize("tile", [1024, 7])
def test_cluster_validity(spark, monkeypatch, tile):
    from acctlens.operators import validity as VA
    monkeypatch.setattr(VA, "TILE", tile)
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(0, 1, (25, 4)), rng.normal(6, 0.5, (20, 4)), rng.normal((0, 9, 0, 3), 1.5, (15, 4)), rng.uniform(-9, 9, (5, 4))])
    labels = np.repeat([0, 1, 2, -1], [25, 20, 15, 5])
    names = [f"a{i:03d}" for i in range(len(X))]
    feat = spark.createDataFrame(pd.DataFrame(X, columns=["f0", "f1", "f2", "f3"]).assign(Account=names))
    lab = spark.createDataFrame([(a, None if c < 0 else f"c{c}") for a, c in zip(names, labels)], "Account string, cluster string")
    assert VA.validity(feat, lab) == pytest.approx(_dbcv(X, labels), abs=1e-9)
    assert VA.validity(feat, lab.withColumn("cluster", F.when(F.col("cluster") == "c0", "c0"))) is None


@pytest.mark.parametrize("low", [4, 0])
def test_cluster_validity_of_large_clusters(spark, monkeypatch, low):
    """Clusters of many panels and blocks, copies among them, beside small ones: equal to the full matrix, few rows asked."""
    from acctlens.operators import validity as VA
    monkeypatch.setattr(VA, "TILE", 8)
    monkeypatch.setattr(VA, "WHOLE", 1)
    monkeypatch.setattr(VA, "LOW", low)
    rng = np.random.default_rng(12)
    sizes = [90, 60, 40, 5, 2, 1]
    X = np.vstack([rng.normal(rng.uniform(-4, 4, 4), 1, (n, 4)) for n in sizes])
    labels = np.repeat(range(len(sizes)), sizes)
    X[7:12], X[95:97] = X[6], X[94]
    names = [f"a{i:03d}" for i in rng.permutation(len(X))]
    order = np.argsort(names)                                   # the full matrix breaks ties by place
    X, labels, names = X[order], labels[order], [names[i] for i in order]
    feat = spark.createDataFrame(pd.DataFrame(X, columns=["f0", "f1", "f2", "f3"]).assign(Account=names))
    lab = spark.createDataFrame([(a, f"c{c}") for a, c in zip(names, labels)], "Account string, cluster string")
    got = {r.cluster: r for r in VA.cluster_validity(feat, lab).collect()}
    assert {c: r["size"] for c, r in got.items()} == {f"c{c}": n for c, n in enumerate(sizes)}
    want = _validity_parts(X, labels)
    for c, (sparse, sep) in want.items():
        assert (got[f"c{c}"].sparseness, got[f"c{c}"].separation) == (pytest.approx(sparse, abs=1e-12), pytest.approx(sep, abs=1e-12))


def _validity_parts(X, labels):
    """(sparseness, separation) of each cluster from a full distance matrix, by Kruskal over (w, place, place)."""
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    inner, sparse, core = {}, {}, np.zeros(len(X))
    for c in set(labels.tolist()):
        i = np.flatnonzero(labels == c)
        for p in i if len(i) > 1 else []:
            with np.errstate(divide="ignore"):
                s = ((1 / D[p, i[i != p]]) ** X.shape[1]).mean()
            core[p] = 0.0 if np.isinf(s) else s ** (-1 / X.shape[1])
        M = np.maximum(np.maximum(core[i][:, None], core[i][None]), D[np.ix_(i, i)])
        part, edges = list(range(len(i))), []
        for w, a, b in sorted((M[a, b], a, b) for b in range(len(i)) for a in range(b)):
            if part[a] != part[b]:
                edges.append((w, a, b))
                part = [part[a] if x == part[b] else x for x in part]
        degree = np.bincount([x for e in edges for x in e[1:]], minlength=len(i)) if edges else np.zeros(len(i))
        sparse[c] = max([w for w, a, b in edges if degree[a] > 1 and degree[b] > 1] or [e[0] for e in edges] or [0.0])
        inner[c] = i[degree > 1] if (degree > 1).any() else i
    def away(c):
        return min(max(core[p], core[q], D[p, q]) for e in inner if e != c for p in inner[c] for q in inner[e])
    return {c: (sparse[c], away(c)) for c in inner}


def test_validity_work_and_rows_are_bounded(spark, monkeypatch):
    """A large cluster's rows go to each panel of it, not to each tile; its first edges are found among few blocks."""
    from acctlens.operators import validity as VA
    monkeypatch.setattr(VA, "TILE", 4)
    monkeypatch.setattr(VA, "WHOLE", 1)
    assert [spark.range(1).select(VA._panels(F.lit(n))).first()[0] for n in (4, 20, 64, 1000, 4000)] == [1, 5, 16, 16, 63]
    rng = np.random.default_rng(3)
    x, mult = rng.normal(0, 1, (600, 4)), np.ones(600)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = (d ** -4).sum(axis=1)
    assert np.allclose(VA._inverse_sums(x, x, mult, mult, True)[0], want, rtol=1e-12)
    rows = spark.range(5000).select(F.format_string("a%04d", "id").alias("pid"), F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("cluster"))
    for c in ("few", "many"):                                   # none below the last is left out
        names = sorted(r.pid for r in VA.least_names(rows).where(F.col("cluster") == c).collect())
        assert 4 <= len(names) <= 80 and names == sorted(r.pid for r in rows.where(F.col("cluster") == c).collect())[: len(names)]
    a, b = VA._inverse_sums(x[:250], x[250:], mult[:250], 2 * mult[250:], False)
    assert np.allclose(a, 2 * (d[:250, 250:] ** -4).sum(axis=1), rtol=1e-12) and np.allclose(b, (d[250:, :250] ** -4).sum(axis=1), rtol=1e-12)


def test_separation_asks_near_blocks_only(spark, monkeypatch):
    """Many clusters, some of copies, some larger than a block: equal to all pairs, and few rows are asked."""
    from acctlens.operators import validity as VA
    monkeypatch.setattr(VA, "TILE", 16)
    rng = np.random.default_rng(9)
    centres, size = rng.uniform(-50, 50, (30, 4)), rng.integers(3, 60, 30)
    X = np.vstack([np.repeat(c[None], n, 0) + (rng.normal(0, 0.5, (n, 4)) if i % 3 else 0) for i, (c, n) in enumerate(zip(centres, size))])
    of, core = np.repeat(np.arange(30), size), rng.uniform(0, 30, len(X))
    rows = [(f"a{i}", f"c{c}", float(r), *map(float, x)) for i, (x, c, r) in enumerate(zip(X, of, core))]
    df = spark.createDataFrame(rows, "Account string, cluster string, core double, f0 double, f1 double, f2 double, f3 double")
    D = np.maximum(np.maximum(core[:, None], core[None]), np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2)))
    D[of[:, None] == of[None]] = np.inf
    got = {r.cluster: r.separation for r in VA.separations(df).collect()}
    assert got == {f"c{c}": D[of == c].min() for c in range(30)}
    assert VA.separations(df.where("cluster = 'c1'")).collect() == []


def test_outlier_counts_of_no_accounts(spark):
    from acctlens.operators import results as RE
    none = spark.createDataFrame([], "Account string, outlier_flag int")
    assert tuple(RE.outlier_counts(none).first()) == (0, 0, 0.0)


def test_quantiles_of_ties(spark):
    from acctlens.functions.median import global_quantile, group_median
    values = [1.0] * 300 + [5.0] * 4000 + list(np.linspace(5, 9, 700))
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("s", 2.0)], "k string, v double")
    got = {r.k: r["median"] for r in group_median(df, "k", "v", cap=200).collect()}
    assert got == {"k": np.median(values), "s": 2.0}
    for q in (0.05, 0.059, 0.86, 0.9, 0.999):
        assert global_quantile(df.where("k = 'k'"), "v", q, cap=200) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_scratch_tables_are_deleted(spark):
    import os
    from acctlens import session
    with session.scratch_scope(spark):
        t = session.cut_lineage(spark.range(5))
        path = t.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path) and t.count() == 5
    assert not os.path.exists(os.path.dirname(path))


def test_mad_of_small_groups_reads_the_rows_once(spark):
    rng = np.random.default_rng(7)
    groups = {f"S{i}": [float(v) for v in np.round(rng.normal(size=n), 2)] for i, n in enumerate([1, 2, 3, 10, 301, 600])}
    groups["C"], groups["I"] = [2.5] * 4, [1.0, float("inf"), -3.0, 4.0]
    rows = [(a, v) for a, vs in groups.items() for v in vs] + [("N", None), ("S1", None), ("M", float("nan")), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "Account string, r double").repartition(5)
    got = RS.account_mad(df, max_n=600)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "percentile" not in plan
    have = {r["Account"]: r["mad_residual"] for r in got.collect()}
    assert {*have} == {*groups, "M", None} and math.isnan(have.pop("M")) and have.pop(None) == 1.5
    assert have == {a: float(np.median(np.abs(np.array(vs) - np.median(vs)))) for a, vs in groups.items()}
    general = {r["Account"]: r["mad_residual"] for r in RS.account_mad(df).collect()}
    assert math.isnan(general.pop("M")) and general.pop(None, 1.5) == 1.5 and general == have
