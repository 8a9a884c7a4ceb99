"""Model and cross-validation against a dense NumPy least-squares solve on explicit dummies."""
import math

import numpy as np
import pandas as pd
import pytest

from acctlens.operators import crossval as CV
from acctlens.operators import features as FE
from acctlens.settings import ModelSpec


def _frame(seed=42, n=240):
    rng = np.random.RandomState(seed)
    acc = rng.choice(["A1", "A2", "A3", "A4"], n)
    cot = rng.choice(["Beverage", "Food", "Other"], n)
    per = np.repeat(np.arange(1, 7), n // 6)
    units = rng.randint(10, 100, n).astype(float)
    sales = np.exp(0.7 * np.log(units) + (acc == "A2") * 0.5 + (cot == "Food") * 0.2 + rng.normal(0, 0.1, n)) * 10
    return pd.DataFrame({"Account": acc, "COT": cot, "Period": per, "Units": units, "Sales": sales})


def _dense_oof(pdf, folds):
    """Per held-out fold: dense OLS with intercept + drop-first one-hot of training levels."""
    out = {}
    for f in sorted(set(folds.values())):
        test = pdf[pdf.Period.map(folds) == f]
        train = pdf[pdf.Period.map(folds) != f]

        def design(d, levels):
            cols = [np.ones(len(d)), np.log(d.Units.values)]
            for c, lv in levels:
                cols += [(d[c].values == v).astype(float) for v in lv[1:]]
            return np.column_stack(cols)
        levels = [(c, sorted(train[c].unique())) for c in ("Account", "COT")]
        b, *_ = np.linalg.lstsq(design(train, levels), np.log(train.Sales.values), rcond=None)
        pred = design(test, levels) @ b
        for i, p in zip(test.index, pred):
            out[i] = p
    return out


@pytest.mark.parametrize("absorb", ["auto", None])
def test_cv_matches_dense_lstsq(spark, absorb):
    pdf = _frame()
    pdf["rid"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    spec = ModelSpec("Sales", ("Units",), ("Account", "COT"))
    m, design = FE.prepare(df, spec, "Account", "Period", "rid", absorb=absorb)     # the weight carries the row id
    cv = CV.run_cv(m, design, 3)
    got = {int(r.weight): r.predicted for r in cv.residuals.collect()}
    folds = {r.period: r.fold for r in cv.folds.collect()}
    exp = _dense_oof(pdf, folds)
    assert len(got) == len(pdf)
    assert max(abs(got[i] - exp[i]) for i in range(len(pdf))) < 1e-9


def test_unseen_level_uses_fold_baseline(spark):
    pdf = _frame(n=120)
    pdf.loc[pdf.Period == 1, "Account"] = "A0"     # smallest level, only in period 1
    pdf["rid"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    spec = ModelSpec("Sales", ("Units",), ("Account", "COT"))
    m, design = FE.prepare(df, spec, "Account", "Period", "rid")
    cv = CV.run_cv(m, design, 3)
    got = {int(r.weight): r.predicted for r in cv.residuals.collect()}
    exp = _dense_oof(pdf, {r.period: r.fold for r in cv.folds.collect()})
    assert max(abs(got[i] - exp[i]) for i in range(len(pdf))) < 1e-9


def test_best_k_from_moments_equals_refit(spark):
    pdf = _frame(n=300)
    pdf["Period"] = np.repeat(np.arange(1, 11), 30)
    df = spark.createDataFrame(pdf)
    spec = ModelSpec("Sales", ("Units",), ("Account",))
    m, design = FE.prepare(df, spec, "Account", "Period")
    table = {r.k: r for r in CV.find_optimal_k(m, design, range(2, 6)).collect()}
    for k in (2, 5):
        s = CV.cv_scores(CV.fold_summary(CV.run_cv(m, design, k))).first()
        assert abs(table[k].mean_mse - s.mean_mse) < 1e-9 and abs(table[k].mean_r2 - s.mean_r2) < 1e-9
    assert sum(r.best for r in table.values()) == 1


def test_log_transform_and_guards(spark):
    df = spark.createDataFrame([(0.0, 1.0, "a"), (1.0, 2.0, "b"), (10.0, None, "a")], "A double, B double, C string")
    got = [r.v for r in df.select(FE.log_expr(df.A).alias("v")).collect()]
    assert got[0] == pytest.approx(math.log(1e-6)) and got[1] == 0.0 and got[2] == pytest.approx(math.log(10))
    got = [r.v for r in df.select(FE.log_expr(df.A, "add_constant").alias("v")).collect()]
    assert got == pytest.approx([0.0, math.log(2), math.log(11)])
    m, _ = FE.prepare(df, ModelSpec("A", ("B",), ("C",)), "C", "C")
    assert m.count() == 2                                            # row with missing B dropped
    neg = spark.createDataFrame([(-1.0, 1.0), (1.0, 2.0)], "A double, B double")
    with pytest.raises(FE.NegativeValueError):
        FE.prepare(neg, ModelSpec("A", ("B",)), "B", "B")
    with pytest.raises(ValueError, match="Duplicate"):
        ModelSpec("A", ("A",))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_account_constant_predictor_takes_the_minimum_norm_solution(spark, seed):
    """A predictor that is constant per account is collinear with the account effect; accounts unseen in
    training show which of the equally good fits was taken."""
    rng = np.random.RandomState(seed)
    n = 600
    pdf = pd.DataFrame({"Account": rng.choice([f"A{i:02d}" for i in range(30)], n), "Period": rng.randint(1, 7, n),
                        "Units": rng.randint(1, 50, n).astype(float), "COT": rng.choice(["x", "y", "z"], n)})
    pdf.loc[pdf.Account == "A03", "Period"] = 2                 # held out together: unseen in one fold
    pdf.loc[pdf.Account == "A00", "Period"] = 5
    store = {a: 10.0 + 7 * i % 90 for i, a in enumerate(sorted(pdf.Account.unique()))}
    pdf["Store"] = pdf.Account.map(store)
    pdf["Sales"] = np.exp(0.6 * np.log(pdf.Store) + 0.3 * np.log(pdf.Units) + rng.normal(0, 0.1, n))
    pdf["rid"] = np.arange(n)
    spec = ModelSpec("Sales", ("Store", "Units"), ("Account", "COT"))
    m, design = FE.prepare(spark.createDataFrame(pdf), spec, "Account", "Period", "rid")
    cv = CV.run_cv(m, design, 3)
    got = {int(r.weight): r.predicted for r in cv.residuals.collect()}
    folds = {r.period: r.fold for r in cv.folds.collect()}
    fold = pdf.Period.map(folds)
    for f in sorted(set(folds.values())):
        train, test = pdf[fold != f], pdf[fold == f]

        def matrix(part):
            cols = [np.log(part.Store), np.log(part.Units)]
            for c in ("Account", "COT"):
                cols += [(part[c] == lv).astype(float) for lv in sorted(train[c].unique())[1:]]
            return np.column_stack(cols)

        x, y = matrix(train), np.log(train.Sales.values)
        b = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
        want = y.mean() + (matrix(test) - x.mean(0)) @ b
        assert np.abs(np.array([got[i] for i in test.rid]) - want).max() < 1e-7


def test_large_offsets_do_not_cancel(spark):
    rng = np.random.RandomState(4)
    pdf = pd.DataFrame({"Account": rng.choice(["a", "b", "c"], 200), "Period": rng.randint(1, 5, 200), "X": 1e6 + rng.rand(200)})
    pdf["Y"] = 1e7 + 3 * pdf.X + rng.normal(0, 1e-3, 200)
    spec = ModelSpec("Y", ("X",), ("Account",), log_transform=False)
    m, design = FE.prepare(spark.createDataFrame(pdf), spec, "Account", "Period")
    s = FE.Design(design.continuous, design.dummies, design.absorbed, design.target, design.mean_y, design.mean_x)
    best = CV.find_optimal_k(m, s, range(2, 4)).collect()
    whole = {k: CV.cv_scores(CV.fold_summary(CV.run_cv(m, s, k))).first() for k in (2, 3)}
    for r in best:
        assert r.mean_mse == pytest.approx(whole[r.k].mean_mse, rel=1e-6)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", 1, float("nan"), 2.0), ("a", 1, 3.0, float("nan")), ("b", 2, 3.0, 4.0), ("b", 2, None, 4.0)],
                               "Account string, Period int, A double, B double")
    spec = ModelSpec("A", ("B",), ("Account",))
    assert FE.prepare(df, spec, "Account", "Period")[0].count() == 1
    assert FE.dropped_rows(df, spec).first()["n_dropped"] == 3
    imputed = FE.prepare(df, ModelSpec("A", ("B",), ("Account",), drop_na=False), "Account", "Period")[0].orderBy("x0").collect()
    assert [r.x0 for r in imputed] == pytest.approx([0.0, math.log(4)])


def test_slot_metrics_equal_scored_rows(spark):
    """K8 from the moments equals the scored rows of every fold, levels unseen in training included."""
    from acctlens.operators import crossval as CV
    rng = np.random.default_rng(5)
    rows = [("a9" if i % 66 == 0 else f"a{i % 7}", int(i % 6), 1.0, float(rng.uniform(1, 9)), float(rng.uniform(1, 9))) for i in range(240)]
    df = spark.createDataFrame(rows, "Account string, Time_Period int, W double, Y double, X double")
    spec = ModelSpec("Y", ("X",), ("Account",))
    m, design = FE.prepare(df, spec, "Account", "Time_Period", "W")
    got = {r.k: r for r in CV.find_optimal_k(m, design, range(2, 5)).collect()}
    for k in (2, 3, 4):
        want = CV.cv_scores(CV.fold_summary(CV.run_cv(m, design, k))).first()
        for c in ("mean_mse", "std_mse", "mean_r2", "std_r2"):
            assert got[k][c] == pytest.approx(want[c], abs=1e-9)
