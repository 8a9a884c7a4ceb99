"""Grouped cross-validation.

K1 assigns whole periods to folds greedily (largest period first to the currently lightest
fold, lowest fold number on ties; equal sizes: larger period id first).  Only the per-period
row counts are involved: they are folded with one ``aggregate`` higher-order expression over
the sorted (period, count) array and come back through ``inline`` — never rows.

K3 runs every fold of one k from one moment table (one pass over rows) plus one scoring pass
for the out-of-fold residuals.  K8 evaluates all 54 folds of k = 2..10 from the same moment
table with no further pass over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.operators.features import Design
from acctlens.operators.regress import fit_slots, moment_table, predict_rows, r2_expr, slot_metrics
from acctlens.session import cut_lineage


def period_counts(T: DataFrame) -> DataFrame:
    return T.groupBy("period").agg(F.sum("n").alias("c"))


def fold_assignment(counts: DataFrame, ks: list[int]) -> DataFrame:
    """K1: (k, period, fold) for every k in ``ks``; ``counts`` is (period, c)."""
    ptype = counts.schema["period"].dataType.simpleString()
    arr = counts.agg(F.collect_list(F.struct(F.col("c").cast("long").alias("c"), F.col("period"))).alias("a"))
    arr = arr.select(F.expr("""array_sort(a, (l, r) -> CASE WHEN l.c > r.c THEN -1 WHEN l.c < r.c THEN 1
                                 WHEN l.period > r.period THEN -1 WHEN l.period < r.period THEN 1 ELSE 0 END)""")
                     .alias("a"), F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    pick = "array_position(acc.loads, array_min(acc.loads))"
    greedy = f"""aggregate(a,
        named_struct('loads', array_repeat(CAST(0 AS BIGINT), k),
                     'out', CAST(array() AS ARRAY<STRUCT<period: {ptype}, fold: INT>>)),
        (acc, x) -> named_struct(
            'loads', transform(acc.loads, (l, i) -> IF(i + 1 = {pick}, l + x.c, l)),
            'out', concat(acc.out, array(named_struct('period', x.period, 'fold', CAST({pick} AS INT))))),
        acc -> acc.out)"""
    return arr.select("k", F.inline(F.expr(greedy))).select(F.col("k").cast("int"), "period", "fold")


def local_folds(T: DataFrame, ks: list[int]) -> tuple[DataFrame, int]:
    """The period → fold map (#periods × #k rows — the calendar, not the data) as a local
    relation (read by several small jobs, needs no write) and the number of periods (K2)."""
    f = fold_assignment(period_counts(T), ks)
    rows = f.collect()
    return T.sparkSession.createDataFrame(rows, f.schema), len({r["period"] for r in rows})


@dataclass
class CVResult:
    k: int
    folds: DataFrame          # k, period, fold
    residuals: DataFrame      # K7 long table
    moments: DataFrame
    total_rows: int


def _slots(folds: DataFrame) -> DataFrame:
    return folds.select(F.col("k").alias("slot_k"), F.col("fold").alias("slot_f"), "period")


def prepare_moments(m: DataFrame, design: Design) -> DataFrame:
    """The moment table, written to the shared checkpoint folder (cuts the row lineage)."""
    return cut_lineage(moment_table(m, design))


def run_cv(m: DataFrame, design: Design, k: int, T: DataFrame | None = None) -> CVResult:
    """K3: refit on all but one fold, predict the held-out periods; one row per observation.

    The model frame (``prepare`` has written its narrow columns) is read twice: for the moment
    table and for the scoring pass."""
    T = prepare_moments(m, design) if T is None else T
    folds, ng = local_folds(T, [k])
    if ng < k:
        raise ValueError(f"Not enough groups for {k} splits. Found only {ng} unique values in 'period'")
    sl = _slots(folds)
    slots = [(k, f) for f in range(1, k + 1)]
    fit = fit_slots(T, design, sl, sl, slots)
    scored = predict_rows(m, fit, sl)
    # K7 is read by several jobs downstream (metrics, account statistics, export): write it once.
    res = cut_lineage(scored.select(F.col("slot_f").alias("fold"), "account", F.col("y").alias("actual"),
                                    "predicted", "residual", "weight", "period"))
    return CVResult(k, folds, res, T, fit.total_n)


def fold_summary(cv: CVResult) -> DataFrame:
    """K4 + K6: per fold n_train, n_test, mse, r2, mean and population std of the residuals."""
    r = cv.residuals
    g = r.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.sum(F.col("residual") ** 2).alias("sse"),
                              F.var_pop("actual").alias("vy"), F.avg("residual").alias("mean_residual"),
                              F.stddev_pop("residual").alias("std_residual"))
    n = F.col("n_test")
    return g.select("fold", (F.lit(cv.total_rows) - n).alias("n_train"), "n_test",
                    (F.col("sse") / n).alias("mse"), r2_expr(F.col("sse"), F.col("vy") * n, n).alias("r2"),
                    "mean_residual", "std_residual")


def cv_scores(summary: DataFrame) -> DataFrame:
    """K5: mean and population std over folds of MSE and R², unweighted."""
    return summary.agg(F.avg("mse").alias("mean_mse"), F.stddev_pop("mse").alias("std_mse"),
                       F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"))


def fold_mse_vs_mean(summary: DataFrame) -> DataFrame:
    """K9: each fold's MSE next to the mean over folds (a window over a k-row table)."""
    from pyspark.sql import Window
    return summary.select("fold", "mse", F.avg("mse").over(Window.partitionBy()).alias("mean_mse"))


def find_optimal_k(m: DataFrame, design: Design, k_range=range(2, 11), T: DataFrame | None = None) -> DataFrame:
    """K8 + V11: for every feasible k the mean/std of fold MSE and R²; ``best`` marks the
    lowest mean MSE (first k on ties).  One moment table, no further pass over rows."""
    T = prepare_moments(m, design) if T is None else T
    folds, ng = local_folds(T, list(k_range))
    ks = [k for k in k_range if k <= ng]
    if not ks:
        raise ValueError(f"No k in {list(k_range)} fits {ng} groups")
    folds = folds.where(F.col("k").isin(ks))
    sl = _slots(folds)
    slots = [(k, f) for k in ks for f in range(1, k + 1)]
    fit = fit_slots(T, design, sl, sl, slots)
    met = slot_metrics(T, fit, sl)
    per_k = met.groupBy(F.col("slot_k").alias("k")).agg(
        F.avg("mse").alias("mean_mse"), F.stddev_pop("mse").alias("std_mse"),
        F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"))
    return mark_best(per_k)


def mark_best(per_k: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    best = F.min_by("k", F.struct("mean_mse", "k")).over(Window.partitionBy())
    return per_k.select("k", "mean_mse", "std_mse", "mean_r2", "std_r2", (F.col("k") == best).alias("best"))


def k_bounds_table(df: DataFrame, date: str, weeks: int, saved: int | None = None) -> DataFrame:
    """K10 from the data's own span: upper, chosen."""
    n = F.floor(F.timestamp_diff("DAY", F.min(date), F.max(date)) / F.lit(7.0) / weeks)
    upper = F.greatest(F.lit(2), F.least(F.lit(10), n)).cast("int")
    return df.agg(upper.alias("upper")).select("upper", F.greatest(F.lit(2), F.least(F.lit(5 if saved is None else saved), F.col("upper")))
                                               .cast("int").alias("chosen"))


def k_bounds(complete_periods: int, best_k: int | None = None, saved: int | None = None) -> tuple[int, int]:
    """The k slider's upper bound (complete periods, at most 10) and its default."""
    upper = max(2, min(10, complete_periods))
    default = saved if saved is not None else (best_k if best_k is not None else 5)
    return upper, max(2, min(default, upper))
