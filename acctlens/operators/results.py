"""Result views over the flagged accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def outlier_counts(acc: DataFrame) -> DataFrame:
    """O1: outliers, accounts, rate (0 when there are no accounts)."""
    return acc.agg(F.coalesce(F.sum("outlier_flag"), F.lit(0)).cast("long").alias("n_outliers"), F.count(F.lit(1)).alias("n_accounts")) \
        .select("n_outliers", "n_accounts",
                F.coalesce(F.try_divide(F.col("n_outliers").cast("double"), F.col("n_accounts")), F.lit(0.0))
                .alias("outlier_rate"))


def outlier_accounts(acc: DataFrame, outlier_type: str | None = None) -> DataFrame:
    """O2: flagged accounts, optionally of one type."""
    cond = F.col("outlier_type") == outlier_type if outlier_type else F.col("outlier_flag") == 1
    return acc.where(cond).select("Account")


def outlier_summary(acc: DataFrame, outlier_type: str | None = None) -> DataFrame:
    """O3: flagged accounts with their statistics and Outlier_Type, by |w_mean| descending
    (Account breaks ties)."""
    out = acc.where(F.col("outlier_flag") == 1)
    if outlier_type:
        out = out.where(F.col("outlier_type") == outlier_type)
    return out.withColumnRenamed("outlier_type", "Outlier_Type") \
        .orderBy(F.abs("w_mean_residual").desc(), F.col("Account"))


def type_counts(acc: DataFrame) -> DataFrame:
    """Accounts per outlier type."""
    return acc.groupBy("outlier_type").agg(F.count(F.lit(1)).alias("n"))


def top_by_mean(acc: DataFrame, n: int = 10) -> DataFrame:
    """The n accounts with the largest |w_mean_residual| (a distributed top-k)."""
    return acc.orderBy(F.abs("w_mean_residual").desc(), F.col("Account")).limit(n)


def first_per_type(acc: DataFrame, n: int = 5) -> DataFrame:
    """The first n accounts (alphabetically) of each outlier type."""
    w = Window.partitionBy("outlier_type").orderBy("Account")
    return acc.select("outlier_type", "Account", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)
