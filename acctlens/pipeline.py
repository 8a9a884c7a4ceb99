"""The chains a user runs: prepare (L1), analyse (L2), best k (L3), account series (L4).

Each takes and returns DataFrames; settings are the frozen classes of ``settings``.  Wrap a run in
``session.scratch_scope`` to delete its intermediate tables at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from acctlens.operators import crossval as CV
from acctlens.operators import decide as DC
from acctlens.operators import features as FE
from acctlens.operators import filters as FL
from acctlens.operators import periods as PE
from acctlens.operators import residuals as RS
from acctlens.operators import results as RE
from acctlens.operators import series as SE
from acctlens.settings import CVSpec, DetectSpec, ModelSpec


@dataclass
class Prepared:
    kept: DataFrame             # rows with their period that pass the filters
    boundaries: DataFrame       # T6
    steps: DataFrame            # F8


def prepare(sales: DataFrame, filters: FL.FilterSpec, weeks: int = 13, date: str = "Date", period: str = "Time_Period") -> Prepared:
    """L1: periods over all rows, then the filters."""
    dated = PE.create_equal_periods(sales, date, weeks, period)
    return Prepared(FL.apply_filters(dated, filters), PE.calendar_boundaries(sales, date, weeks), FL.filter_summary(dated, filters))


@dataclass
class Analysis:
    cv: CV.CVResult
    folds: DataFrame            # K4, K6
    scores: DataFrame           # K5
    stats: DataFrame            # A1–A7
    detection: DC.Detection     # D1–D12
    summary: DataFrame          # O3


def _model(kept: DataFrame, model: ModelSpec, cv: CVSpec):
    cv.check_columns(kept)
    return FE.prepare(kept, model, cv.account_column, cv.group_column, cv.weight_column)


def analyse(kept: DataFrame, model: ModelSpec, cv: CVSpec, detect: DetectSpec = DetectSpec()) -> Analysis:
    """L2: cross-validated residuals, account statistics, detection, ranked outliers."""
    m, design = _model(kept, model, cv)
    run = CV.run_cv(m, design, cv.n_splits)
    folds = CV.fold_summary(run)
    stats = RS.account_stats(run.residuals)
    found = DC.detect(stats, detect)
    return Analysis(run, folds, CV.cv_scores(folds), stats, found, RE.outlier_summary(found.accounts))


def best_k(kept: DataFrame, model: ModelSpec, cv: CVSpec, k_range=range(2, 11)) -> DataFrame:
    """L3: error by number of folds, the best one marked."""
    return CV.find_optimal_k(*_model(kept, model, cv), k_range)


def account_series(sales: DataFrame, kept: DataFrame, account: str = "Account", date: str = "Date") -> DataFrame:
    """L4: the full series of every account that survived the filters, in order."""
    return SE.account_series(SE.rows_of_accounts(sales, kept, account), account=account, date=date, ordered=True)
