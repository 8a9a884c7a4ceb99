"""acctlens — find the accounts whose sales a log-linear model cannot explain, on Spark.

Every operator is a function from DataFrame (plus frozen settings) to DataFrame.  The heavy
work — scans, filters, period assignment, per-(period, account) moment sums, fold scoring,
residual statistics, neighbour joins, forest scoring — runs as Spark SQL plans.  The driver
only ever holds schema, one-row aggregates, the period→fold map and small coefficient
vectors / Gram matrices whose size depends on the model, and bounded pages of levels.
"""

from acctlens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
