"""Residual statistics per account (A1–A8): observations → one row per account.

Weighted mean, population std and skewness are computed in two passes (the mean is joined
back before the central moments) to avoid the cancellation of raw power sums.  Both passes
are partial (map-side) aggregates; the join-back of the per-account mean is a sort-merge
join that AQE splits when one account is hot, or a broadcast when AQE sees the per-account
table is small.  The median absolute deviation uses the skew-safe exact ``group_median``.

The z-score (A7) and the standardised feature matrix (A8) need one-row aggregates over
accounts; those few numbers are read on the driver and applied as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.functions.median import DEFAULT_CAP, group_median, small_group_mad
from acctlens.session import cut_lineage, sized_broadcast

FEATURES = ["w_mean_residual", "z_mean_residual", "w_std_residual", "w_skew_residual"]
# std below this fraction of max(1, |mean|) is floating-point noise of a constant account
STD_TOL = 1e-12


def account_stats(res: DataFrame, account: str = "account", residual: str = "residual",
                  weight: str | None = "weight", median_cap: int | None = None) -> DataFrame:
    """Account, w_mean_residual, w_std_residual, w_skew_residual, mad_residual,
    count, z_mean_residual."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    r = (res.where(F.col(account).isNotNull())
         .select(F.col(account).alias("Account"), F.col(residual).cast("double").alias("r"), w.alias("w")))
    m1 = r.groupBy("Account").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("r")).alias("swr"),
                                  F.count(F.lit(1)).alias("count"))
    # one row per account, read three times below: materialise it (cuts the row lineage too)
    m1 = cut_lineage(m1.select("Account", "sw", "count",
                               F.when(F.col("sw") == 0, F.raise_error(F.lit("Weights sum to zero, can't be normalized")))
                               .otherwise(F.col("swr") / F.col("sw")).alias("w_mean_residual")))
    sizes = m1.agg(F.max("count").alias("mx"), F.count(F.lit(1)).alias("na")).first()
    max_n, n_acc = sizes["mx"] or 0, sizes["na"]
    c = r.join(sized_broadcast(m1.select("Account", "w_mean_residual"), n_rows=n_acc), "Account")
    d = F.col("r") - F.col("w_mean_residual")
    m2 = c.groupBy("Account").agg(F.sum(F.col("w") * d * d).alias("s2"), F.sum(F.col("w") * d * d * d).alias("s3"))
    st = m1.join(m2, "Account")
    std = F.sqrt(F.col("s2") / F.col("sw"))
    tiny = std < F.lit(STD_TOL) * F.greatest(F.lit(1.0), F.abs(F.col("w_mean_residual")))
    st = st.select("Account", "w_mean_residual", "count", "sw",
                   F.when(tiny, F.lit(0.0)).otherwise(std).alias("w_std_residual"), "s3")
    st = st.select("Account", "w_mean_residual", "w_std_residual",
                   F.when(F.col("w_std_residual") > 0,
                          (F.col("s3") / F.col("sw")) / F.pow(F.col("w_std_residual"), 3)).otherwise(F.lit(0.0))
                   .alias("w_skew_residual"), "count")
    mad = account_mad(r, median_cap, max_n, n_acc)
    st = st.join(mad, "Account")
    return with_zscore(st)


def account_mad(r: DataFrame, cap: int | None = None, max_n: int | None = None,
                n_accounts: int | None = None) -> DataFrame:
    """A5: median(|r − median(r)|) per account, unweighted, unscaled."""
    if max_n is not None and max_n <= (cap or DEFAULT_CAP):
        return small_group_mad(r, "Account", "r", "mad_residual")
    kw = {"cap": cap or DEFAULT_CAP, "max_group_size": max_n}
    med = cut_lineage(group_median(r, "Account", "r", "__med", **kw))
    dev = r.join(sized_broadcast(med, n_rows=n_accounts), "Account").select("Account", F.abs(F.col("r") - F.col("__med")).alias("__ad"))
    return group_median(dev, "Account", "__ad", "mad_residual", **kw)


def with_zscore(st: DataFrame) -> DataFrame:
    """(mean − mean of means) / population std of means; 0 when the means do not vary."""
    row = st.agg(F.avg("w_mean_residual").alias("mu"), F.stddev_pop("w_mean_residual").alias("sd")).first()
    mu, sd = row["mu"], row["sd"]
    z = (F.col("w_mean_residual") - F.lit(mu)) / F.lit(sd) if sd and sd > 0 else F.lit(0.0)
    return st.select("Account", "w_mean_residual", "w_std_residual", "w_skew_residual", "mad_residual",
                     "count", z.cast("double").alias("z_mean_residual"))


def feature_matrix(stats: DataFrame) -> DataFrame:
    """The four detection features standardised with the population std; a constant
    column becomes 0.  Output: Account, f0..f3 (in FEATURES order)."""
    row = stats.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURES)]).first()
    cols = []
    for i, c in enumerate(FEATURES):
        mu, sd = row[f"m{i}"], row[f"s{i}"]
        e = (F.col(c) - F.lit(mu)) / F.lit(sd) if sd and sd > 0 else F.col(c) - F.lit(mu)
        cols.append(e.alias(f"f{i}"))
    return stats.select("Account", *cols)
