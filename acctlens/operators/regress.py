"""Ordinary least squares through sufficient statistics (R7–R9, and the engine of K3/K8).

One pass over the model frame builds the **moment table**: per (period, g) the count and the
sums of y, y², x, x·y and x·xᵀ over the dense design columns (log continuous predictors and
indicators of the small categoricals).  Map-side partial aggregation means a hot account
costs one partial row per map task, never a hot reducer.  Everything else — every fold of
every k, the in-sample fit, the held-out error of every fold — is computed from this table,
whose size is (#periods × #accounts) × p², independent of the number of observations.

The absorbed categorical g (the account fixed effect) is swept out with the within
transformation (Frisch–Waugh–Lovell): for a training set S,

    W  = Σ_S x xᵀ − Σ_g sx_g sx_gᵀ / n_g          r = Σ_S x y − Σ_g sx_g sy_g / n_g
    W b = r                                      α_g = (sy_g − sx_g·b) / n_g

which equals OLS with an intercept and one-hot(g) with the first level dropped.  Moments are taken
about the columns' means, so they don't cancel.  Where W lacks rank (a predictor that is constant
within each g, say), b is the part of the minimum-norm solution of the whole centred design —
predictors and dummies of g together — not of W alone (``solve_slot``).  A level of g
that is absent from training gets the fold's baseline level (the smallest training level),
exactly like an unseen category encoded as all zeros.  For the small categoricals, columns
with no training rows are dropped and then the first remaining level (the baseline).

The per-fold correction Σ_g φ(train_g) is computed as Σ_g φ(total_g) plus a correction over
only the groups that have held-out rows, so no (fold × group) product is ever formed.
Driver state: per-period moment sums (#periods × p²), per-fold corrections (#folds × p²),
coefficient vectors, and a page of at most ``PAGE`` levels while baselines are looked up.  p counts
the continuous predictors and the levels of the categoricals that aren't absorbed; the Gram is
p × p, so the categorical with many levels should be the absorbed one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctlens.operators.features import Design
from acctlens.session import cut_lineage, sized_broadcast

SLOT = ["slot_k", "slot_f"]


# ------------------------------------------------------------------ design columns

def design_exprs(design: Design) -> list[Column]:
    out = []
    for kind, i, lv in design.columns:
        if kind == "x":
            out.append(F.col(f"x{i}"))
        else:
            out.append(F.when(F.col(f"c{i}").eqNullSafe(F.lit(lv)), F.lit(1.0)).otherwise(F.lit(0.0)))
    return out


def _pairs(design: Design):
    """(i, j, kind) for i ≤ j: kind 'sum' (computed), 'zero' (two levels of one categorical),
    'diag' (indicator squared = indicator)."""
    cols = design.columns
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            a, b = cols[i], cols[j]
            if a[0] == "c" and b[0] == "c" and a[1] == b[1]:
                yield i, j, ("diag" if i == j else "zero")
            else:
                yield i, j, "sum"


def _column_means(design: Design) -> list[float]:
    """The means of the continuous columns; indicators stay 0/1."""
    means = list(design.mean_x) or [0.0] * design.n_cont
    return means + [0.0] * (design.p - design.n_cont)


def moment_table(m: DataFrame, design: Design) -> DataFrame:
    """Per (period, g): n, sy, syy, sx_i, sxy_i, sxx_i_j about the design's means — one aggregation
    over the rows."""
    X = [x - F.lit(mean) for x, mean in zip(design_exprs(design), _column_means(design))]
    y = F.col("y") - F.lit(design.mean_y)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    for i, xi in enumerate(X):
        aggs += [F.sum(xi).alias(f"sx_{i}"), F.sum(xi * y).alias(f"sxy_{i}")]
    for i, j, kind in _pairs(design):
        if kind == "sum":
            aggs.append(F.sum(X[i] * X[j]).alias(f"sxx_{i}_{j}"))
    return m.groupBy("period", "g").agg(*aggs)


def _xx(i: int, j: int, kinds: dict) -> Column:
    i, j = min(i, j), max(i, j)
    k = kinds[(i, j)]
    if k == "sum":
        return F.col(f"sxx_{i}_{j}")
    if k == "diag":
        return F.col(f"sx_{i}")
    return F.lit(0.0)


# ------------------------------------------------------------------ fitting

@dataclass
class FoldFit:
    """Coefficients per slot (k, fold) plus the per-(slot, g) intercept table."""
    design: Design
    slots: list[tuple[int, int]]
    coef: dict[tuple[int, int], np.ndarray]
    baseline: dict[tuple[int, int], object]
    coef_df: DataFrame          # slot_k, slot_f, b_0.., alpha0
    alpha: DataFrame            # slot_k, slot_f, g, alpha; en, esy, esx_0..: moments of the rows left out
    total_n: int = 0            # rows in the moment table


def _phi_aggs(p: int, pairs, n: Column, sy: Column, sx: list[Column], prefix: str) -> list[Column]:
    """Σ_g of sx sxᵀ/n, sx·sy/n, sy²/n (0 when n = 0), as named sums."""
    inv = F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0))
    out = [F.sum(sy * sy * inv).alias(f"{prefix}yy")]
    for i in range(p):
        out.append(F.sum(sx[i] * sy * inv).alias(f"{prefix}xy_{i}"))
    for i, j, _ in pairs:     # every pair: sx_i·sx_j/n is non-zero even where x_i·x_j never is
        out.append(F.sum(sx[i] * sx[j] * inv).alias(f"{prefix}xx_{i}_{j}"))
    return out


def _phi_delta_aggs(p: int, pairs, tot, tr, prefix: str) -> list[Column]:
    """Σ over held groups of φ(train) − φ(total)."""
    (n0, sy0, sx0), (n1, sy1, sx1) = tot, tr
    i0 = F.when(n0 > 0, F.lit(1.0) / n0).otherwise(F.lit(0.0))
    i1 = F.when(n1 > 0, F.lit(1.0) / n1).otherwise(F.lit(0.0))
    out = [F.sum(sy1 * sy1 * i1 - sy0 * sy0 * i0).alias(f"{prefix}yy")]
    for i in range(p):
        out.append(F.sum(sx1[i] * sy1 * i1 - sx0[i] * sy0 * i0).alias(f"{prefix}xy_{i}"))
    for i, j, _ in pairs:
        out.append(F.sum(sx1[i] * sx1[j] * i1 - sx0[i] * sx0[j] * i0).alias(f"{prefix}xx_{i}_{j}"))
    return out


def _sym(row, p: int, pairs, prefix: str) -> tuple[np.ndarray, np.ndarray, float]:
    A = np.zeros((p, p))
    for i, j, _ in pairs:
        v = row[f"{prefix}xx_{i}_{j}"] or 0.0
        A[i, j] = A[j, i] = v
    r = np.array([row[f"{prefix}xy_{i}"] or 0.0 for i in range(p)])
    return A, r, float(row[f"{prefix}yy"] or 0.0)


def fit_slots(T: DataFrame, design: Design, excl: DataFrame, test: DataFrame,
              slots: list[tuple[int, int]]) -> FoldFit:
    """Fit one model per slot.  ``excl``/``test``: (slot_k, slot_f, period) — the periods left
    out of training and the periods to predict (equal for cross-validation)."""
    spark = T.sparkSession
    p = design.p
    pairs = list(_pairs(design))
    kinds = {(i, j): k for i, j, k in pairs}

    # (1) raw Gram per period, collected: #periods rows.
    sum_cols = ["n", "sy", "syy"] + [f"sx_{i}" for i in range(p)] + [f"sxy_{i}" for i in range(p)] + \
               [f"sxx_{i}_{j}" for i, j, k in pairs if k == "sum"]
    per = {r["period"]: r for r in T.groupBy("period").agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()}
    ex = {}
    for r in excl.collect():
        ex.setdefault((r["slot_k"], r["slot_f"]), set()).add(r["period"])

    # (2) within corrections.
    tot = cut_lineage(T.groupBy("g").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"),
                                         *[F.sum(f"sx_{i}").alias(f"sx_{i}") for i in range(p)]))
    base = tot.agg(*_phi_aggs(p, pairs, F.col("n"), F.col("sy"), [F.col(f"sx_{i}") for i in range(p)], "c")).first()
    exg = (T.join(F.broadcast(excl), "period")
           .groupBy(*SLOT, "g").agg(F.sum("n").alias("en"), F.sum("sy").alias("esy"),
                                    *[F.sum(f"sx_{i}").alias(f"esx_{i}") for i in range(p)]))
    t0_ = (F.col("n"), F.col("sy"), [F.col(f"sx_{i}") for i in range(p)])
    t1_ = (F.col("n") - F.col("en"), F.col("sy") - F.col("esy"),
          [F.col(f"sx_{i}") - F.col(f"esx_{i}") for i in range(p)])
    # left: a null g has no total, so it counts for nothing here and takes the baseline's level below
    joined = cut_lineage(exg.join(tot, "g", "left"))
    delta = {(r["slot_k"], r["slot_f"]): r
             for r in joined.groupBy(*SLOT).agg(*_phi_delta_aggs(p, pairs, t0_, t1_, "c"),
                                                F.count_if((F.col("n") - F.col("en")) == 0).alias("n_unseen"))
             .collect()}

    # (3) each slot's baseline level (smallest g with training rows) and its moments: one total
    #     row per baseline and at most one held-out row per slot.
    baseline = _baselines(tot, joined, slots, delta)
    g0s = sorted({baseline[s] for s in slots}, key=str)
    tot0 = {r["g"]: r for r in tot.where(F.col("g").isin(g0s)).collect()}
    ex0 = {(r["slot_k"], r["slot_f"], r["g"]): r for r in joined.where(F.col("g").isin(g0s)).collect()}
    first: dict = {}
    for s in slots:
        t0, e0 = tot0[baseline[s]], ex0.get((s[0], s[1], baseline[s]))
        n0 = t0["n"] - (e0["en"] if e0 else 0)
        first[s] = ((t0["sy"] - (e0["esy"] if e0 else 0.0)) / n0,
                    np.array([t0[f"sx_{i}"] - (e0[f"esx_{i}"] if e0 else 0.0) for i in range(p)]) / n0)

    # (4) solve on the driver, per slot.
    Cb, cb, _ = _sym(base, p, pairs, "c")
    grams: dict = {}
    coef: dict = {}
    for s in slots:
        train = [q for q in per if q not in ex.get(s, set())]
        G = np.zeros((p, p))
        gy = np.zeros(p)
        for q in train:
            r = per[q]
            for i, j, kind in pairs:
                v = 0.0 if kind == "zero" else (r[f"sx_{i}"] if kind == "diag" else r[f"sxx_{i}_{j}"])
                G[i, j] += v or 0.0
                if i != j:
                    G[j, i] += v or 0.0
            gy += np.array([r[f"sxy_{i}"] or 0.0 for i in range(p)])
        C, c = Cb.copy(), cb.copy()
        if s in delta:
            Cd, cd, _ = _sym(delta[s], p, pairs, "c")
            C += Cd
            c += cd
        grams[s] = (G - C, gy - c, np.diag(G), np.array(_active_columns(design, np.diag(G)), int))
    lacking = [s for s in slots if _lacks_rank(*grams[s])]
    groups = _group_means(tot, joined, pairs, p, t0=t0_, t1=t1_) if lacking else None
    for s in slots:
        b = np.zeros(p)
        W, rr, diag, idx = grams[s]
        if len(idx):
            b[idx] = solve_slot(W[np.ix_(idx, idx)], rr[idx], diag[idx], _around(groups, s, first[s], idx) if s in lacking else None)
        coef[s] = b

    # (5) intercepts, back in the columns' own units.
    means = np.array(_column_means(design))
    rows = []
    for s in slots:
        y0, x0 = first[s]
        a0 = float(y0 - x0 @ coef[s] + design.mean_y - means @ coef[s])
        rows.append((int(s[0]), int(s[1]), *[float(v) for v in coef[s]], a0))
    coef_df = spark.createDataFrame(
        rows, ", ".join(["slot_k int", "slot_f int"] + [f"b_{i} double" for i in range(p)] + ["alpha0 double"]))
    # per-(slot, g) intercepts for the groups to be predicted, with the moments of the held-out rows
    if test is excl:
        a = joined
    else:
        need = T.join(F.broadcast(test), "period").select(*SLOT, "g").distinct()
        a = need.join(joined.drop("n", "sy", *[f"sx_{i}" for i in range(p)]), SLOT + ["g"], "left").join(tot, "g")
    a = a.select(*SLOT, "g", "en", "esy", *[f"esx_{i}" for i in range(p)],
                 (F.col("n") - F.coalesce(F.col("en"), F.lit(0))).alias("tn"),
                 (F.col("sy") - F.coalesce(F.col("esy"), F.lit(0.0))).alias("tsy"),
                 *[(F.col(f"sx_{i}") - F.coalesce(F.col(f"esx_{i}"), F.lit(0.0))).alias(f"tsx_{i}")
                   for i in range(p)])
    alpha_expr = (F.col("tsy") - sum((F.col(f"tsx_{i}") * F.col(f"b_{i}") for i in range(p)), F.lit(0.0))) / F.col("tn") \
        + F.lit(design.mean_y) - sum((F.lit(float(v)) * F.col(f"b_{i}") for i, v in enumerate(means)), F.lit(0.0))
    # read by the scoring pass and by the metrics: materialise once
    alpha = cut_lineage(a.join(F.broadcast(coef_df), SLOT)
                        .select(*SLOT, "g", F.when(F.col("tn") > 0, alpha_expr).otherwise(F.col("alpha0")).alias("alpha"),
                                "en", "esy", *[f"esx_{i}" for i in range(p)]))
    return FoldFit(design, slots, coef, baseline, coef_df, alpha, int(sum(r["n"] for r in per.values())))


def _active_columns(design: Design, train_diag: np.ndarray) -> list[int]:
    """Continuous columns always; indicators with training rows, minus each categorical's
    first present level (the baseline)."""
    active, seen = [], set()
    for idx, (kind, j, _) in enumerate(design.columns):
        if kind == "x":
            active.append(idx)
        elif train_diag[idx] > 0:
            if j in seen:
                active.append(idx)
            else:
                seen.add(j)
    return active


PAGE = 1000


def _baselines(tot: DataFrame, joined: DataFrame, slots, delta) -> dict:
    """Smallest g with training rows, per slot.  Mostly the global minimum; when some groups have no
    training rows in a slot, the levels are read in order, a page at a time, until every slot has
    one with training rows."""
    unseen = {s for s in delta if delta[s]["n_unseen"]}
    out: dict = {}
    levels = tot.select("g").orderBy("g")
    page = [r["g"] for r in levels.limit(PAGE if unseen else 1).collect()]
    while page:
        zero: dict = {}
        if unseen:
            held = joined.where((F.col("n") - F.col("en")) == 0).where(F.col("g").between(page[0], page[-1]))
            for r in held.select(*SLOT, "g").collect():          # at most slots × PAGE rows
                zero.setdefault((r["slot_k"], r["slot_f"]), set()).add(r["g"])
        for s in slots:
            if s not in out:
                found = next((g for g in page if g not in zero.get(s, ())), None)
                if found is not None:
                    out[s] = found
        if len(out) == len(slots):
            return out
        page = [r["g"] for r in levels.where(F.col("g") > page[-1]).limit(PAGE).collect()]
    raise ValueError("a fold has no training rows")


# ------------------------------------------------------------------ solving

RANK_TOLERANCE = 1e-10


def _scaled(W: np.ndarray, diag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """W over the columns' own variation before sweeping, and the scale."""
    scale = 1 / np.sqrt(np.where(diag > 0, diag, 1.0))
    return W * scale[:, None] * scale[None, :], scale


def _lacks_rank(W: np.ndarray, r: np.ndarray, diag: np.ndarray, idx: np.ndarray) -> bool:
    if not len(idx):
        return False
    scaled, _ = _scaled(W[np.ix_(idx, idx)], diag[idx])
    return bool(np.linalg.eigvalsh(scaled)[0] <= RANK_TOLERANCE * len(idx))


def solve_slot(W: np.ndarray, r: np.ndarray, diag: np.ndarray, around: tuple | None) -> np.ndarray:
    """Coefficients of the predictors.  Full rank: W b = r.  Else b = b0 + V t, V spanning the null
    space of W, and t minimises |b|² + Σ_g (A_g − D_g·b)², the squared norm of the predictors' and
    the dummies' coefficients together; ``around`` = (Σ D Dᵀ, Σ D A) with D_g, A_g the means of x and
    y in group g less those in the baseline group."""
    scaled, scale = _scaled(W, diag)
    values, vectors = np.linalg.eigh(scaled)
    live = values > RANK_TOLERANCE * len(values)
    inverse = vectors[:, live] / values[live] @ vectors[:, live].T
    b0 = scale * (inverse @ (scale * r))
    if around is None or live.all():
        return b0
    V, _ = np.linalg.qr(scale[:, None] * vectors[:, ~live])
    S, q = around
    t = np.linalg.solve(V.T @ V + V.T @ S @ V, V.T @ (q - S @ b0) - V.T @ b0)
    return b0 + V @ t


def _mean_sums(n: Column, sy: Column, sx: list[Column], pairs) -> dict[str, Column]:
    """Per group: 1, mean y, mean x_i, mean x_i · mean y, mean x_i · mean x_j (0 without rows)."""
    mean = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    out = {"g1": F.when(n > 0, 1.0).otherwise(0.0), "gy": mean(sy)}
    for i, x in enumerate(sx):
        out |= {f"gx_{i}": mean(x), f"gxy_{i}": mean(x) * mean(sy)}
    return out | {f"gxx_{i}_{j}": mean(sx[i]) * mean(sx[j]) for i, j, _ in pairs}


def _group_means(tot: DataFrame, joined: DataFrame, pairs, p: int, t0, t1) -> tuple[dict, dict, int]:
    """Sums over groups of their training means: of all rows, and by slot what held-out rows change."""
    every = _mean_sums(*t0, pairs)
    base = tot.agg(*(F.sum(c).alias(k) for k, c in every.items())).first().asDict()
    train = _mean_sums(*t1, pairs)
    change = joined.groupBy(*SLOT).agg(*(F.sum(train[k] - every[k]).alias(k) for k in every)).collect()
    return base, {(r["slot_k"], r["slot_f"]): r.asDict() for r in change}, p


def _around(groups: tuple, slot, first: tuple, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base, change, p = groups
    at = lambda k: base[k] + change.get(slot, {}).get(k, 0.0)
    y0, x0 = first
    n, sy, sx = at("g1"), at("gy"), np.array([at(f"gx_{i}") for i in range(p)])
    sxy = np.array([at(f"gxy_{i}") for i in range(p)])
    sxx = np.array([[at(f"gxx_{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)])
    S = sxx - np.outer(sx, x0) - np.outer(x0, sx) + n * np.outer(x0, x0)
    q = sxy - x0 * sy - y0 * sx + n * x0 * y0
    return S[np.ix_(idx, idx)], q[idx]


# ------------------------------------------------------------------ scoring

def predict_rows(m: DataFrame, fit: FoldFit, test: DataFrame) -> DataFrame:
    """One pass over the rows of the test periods — predicted = α_g + x·b."""
    p = fit.design.p
    X = design_exprs(fit.design)
    lin = sum((X[i] * F.col(f"b_{i}") for i in range(p)), F.lit(0.0))
    scored = (m.join(F.broadcast(test), "period")
              .join(sized_broadcast(fit.alpha.select(*SLOT, "g", "alpha")), SLOT + ["g"], "left")
              .join(F.broadcast(fit.coef_df), SLOT))
    pred = F.coalesce(F.col("alpha"), F.col("alpha0")) + lin
    return scored.select("*", pred.alias("predicted")).withColumn("residual", F.col("y") - F.col("predicted"))


def slot_metrics(T: DataFrame, fit: FoldFit, test: DataFrame) -> DataFrame:
    """Held-out error per slot from the moment table alone (no pass over rows), ``test`` being what the fit left
    out: SSE = Σ_cells [syy − 2b·sxy + bᵀ sxx b − 2α(sy − b·sx) + nα²]."""
    design = fit.design
    p = design.p
    kinds = {(i, j): k for i, j, k in _pairs(design)}
    b = [F.col(f"b_{i}") for i in range(p)]
    centre = F.lit(design.mean_y) - sum((F.lit(v) * x for v, x in zip(_column_means(design), b)), F.lit(0.0))
    bsx = sum((b[i] * F.col(f"sx_{i}") for i in range(p)), F.lit(0.0))
    bsxy = sum((b[i] * F.col(f"sxy_{i}") for i in range(p)), F.lit(0.0))
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            if kinds[(i, j)] == "zero":
                continue
            term = b[i] * b[j] * _xx(i, j, kinds)
            quad = quad + (term if i == j else term * 2.0)
    # what the intercepts don't enter comes from the sums of the periods; an intercept is the same for all
    # periods of its slot, so the groups' held-out moments serve for the rest
    sums = ["n", "sy", "syy", *[f"s{x}_{i}" for x in ("x", "xy") for i in range(p)], *[f"sxx_{i}_{j}" for (i, j), k in kinds.items() if k == "sum"]]
    periods = T.groupBy("period").agg(*[F.sum(c).alias(c) for c in sums])
    whole = (periods.join(F.broadcast(test), "period").groupBy(*SLOT).agg(*[F.sum(c).alias(c) for c in sums])
             .join(F.broadcast(fit.coef_df), SLOT)
             .select(*SLOT, F.col("n").alias("n_test"), "sy", "syy", (F.col("syy") - 2.0 * bsxy + quad).alias("fixed"), (F.col("sy") - bsx).alias("rest")))
    a = F.col("alpha") - centre                                       # about the means, as the moments are
    held = F.col("esy") - sum((b[i] * F.col(f"esx_{i}") for i in range(p)), F.lit(0.0))
    by_group = (fit.alpha.join(F.broadcast(fit.coef_df), SLOT).groupBy(*SLOT).agg(
        F.sum(F.col("en") * a * a - 2.0 * a * held).alias("change"), F.sum(F.col("en") * a).alias("shift")))
    g = whole.join(by_group, SLOT).withColumn("sse", F.col("fixed") + F.col("change")).withColumn("sres", F.col("rest") - F.col("shift"))
    n = F.col("n_test")
    sstot = F.col("syy") - F.col("sy") * F.col("sy") / n
    return g.select(*SLOT, "n_test", (F.col("sse") / n).alias("mse"),
                    r2_expr(F.col("sse"), sstot, n).alias("r2"),
                    (F.col("sres") / n).alias("mean_residual"),
                    F.sqrt(F.greatest(F.col("sse") / n - (F.col("sres") / n) ** 2, F.lit(0.0))).alias("std_residual"))


def r2_expr(sse: Column, sstot: Column, n: Column) -> Column:
    """1 − SSE/SStot; constant actuals → 1 if perfect else 0; a single row → NULL."""
    return (F.when(n < 2, F.lit(None).cast("double"))
            .when(sstot <= 0, F.when(sse <= 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - sse / sstot))


# ------------------------------------------------------------------ in-sample fit

def fit_all(m: DataFrame, design: Design, T: DataFrame | None = None) -> tuple[FoldFit, DataFrame]:
    """One model on every row (slot (0, 0), nothing excluded)."""
    spark = m.sparkSession
    T = cut_lineage(moment_table(m, design)) if T is None else T      # read four times
    periods = T.select("period").distinct()
    test = periods.select(F.lit(0).alias("slot_k"), F.lit(0).alias("slot_f"), "period")
    excl = spark.createDataFrame([], f"slot_k int, slot_f int, period {T.schema['period'].dataType.simpleString()}")
    return fit_slots(T, design, excl, test, [(0, 0)]), test


def in_sample_report(m: DataFrame, design: Design) -> DataFrame:
    """MSE and R² of the in-sample fit, from one scoring pass."""
    fit, test = fit_all(m, design)
    s = predict_rows(m, fit, test)
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("residual") ** 2).alias("mse"),
                 F.sum(F.col("residual") ** 2).alias("sse"), F.var_pop("y").alias("vy")) \
        .select("n", "mse", r2_expr(F.col("sse"), F.col("vy") * F.col("n"), F.col("n")).alias("r2"))
