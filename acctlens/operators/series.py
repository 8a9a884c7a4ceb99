"""Account series and comparisons.

A single pass produces every account's series (a semi join picks the accounts), ordered by account
and date where the order is asked for, and the comparison table (V9) is one grouped aggregate over
all rows of every account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctlens.functions.columns import metric_columns, qcol


def price_expr(dollars: Column, units: Column, divide_always: bool = False) -> Column:
    """V2: dollars / units where units > 0, else missing.  V2b (``divide_always``): divide
    whenever the quotient is finite (negative units give a price; x/0 gives missing)."""
    if divide_always:
        q = F.try_divide(dollars.cast("double"), units.cast("double"))
        return F.when(units != 0, q)
    return F.when(units > 0, dollars.cast("double") / units.cast("double"))


def account_series(df: DataFrame, accounts: DataFrame | None = None, account: str = "Account",
                   date: str = "Date", divide_always: bool = False, ordered: bool = False) -> DataFrame:
    """V3: per account and date: units, base units, average price, average base price.
    ``accounts`` (a one-column frame) restricts the output with a semi join; ``ordered`` sorts by
    account and date, as a chart needs it."""
    cols = metric_columns(df.columns)
    out = df
    if accounts is not None:
        out = out.join(accounts.select(F.col(accounts.columns[0]).alias(account)), account, "left_semi")

    def c(name):
        return qcol(cols[name]) if cols[name] else F.lit(None).cast("double")

    price = (price_expr(c("dollars"), c("units"), divide_always) if cols["dollars"] and cols["units"]
             else F.lit(None).cast("double"))
    bprice = (price_expr(c("base_dollars"), c("base_units"), divide_always) if cols["base_dollars"] and cols["base_units"]
              else F.lit(None).cast("double"))
    out = out.select(qcol(account).alias("Account"), qcol(date).alias("Date"),
                      c("units").cast("double").alias("Units"), c("base_units").cast("double").alias("Base_Units"),
                      price.alias("Avg_Price"), bprice.alias("Avg_Base_Price"))
    return out.orderBy("Account", "Date") if ordered else out


def with_position(series: DataFrame, account: str = "Account", date: str = "Date") -> DataFrame:
    """V3's order as a column: each row's place in its account's series."""
    rest = [qcol(c) for c in series.columns if c not in (account, date)]
    return series.withColumn("position", F.row_number().over(Window.partitionBy(qcol(account)).orderBy(qcol(date), *rest)))


def date_range(df: DataFrame, date: str = "Date") -> DataFrame:
    """V4: the date range shared by every chart."""
    return df.agg(F.min(qcol(date)).alias("min_date"), F.max(qcol(date)).alias("max_date"))


def rows_of_accounts(original: DataFrame, kept: DataFrame, account: str = "Account") -> DataFrame:
    """V5 (semi join): every unfiltered row of the accounts that survived filtering."""
    return original.join(kept.select(account).distinct(), account, "left_semi")


def unflagged_accounts(acc: DataFrame) -> DataFrame:
    """V6 (anti join): accounts not flagged."""
    return acc.select("Account").join(acc.where(F.col("outlier_flag") == 1).select("Account"), "Account", "left_anti")


def with_badge(accounts: DataFrame, acc: DataFrame, account: str = "Account") -> DataFrame:
    """V7 (lookup join): each account with its outlier type, default 'normal'."""
    return (accounts.select(F.col(account).alias("Account")).distinct()
            .join(acc.select("Account", "outlier_type"), "Account", "left")
            .select("Account", F.coalesce("outlier_type", F.lit("normal")).alias("outlier_type")))


def first_accounts(df: DataFrame, n: int = 20, account: str = "Account") -> DataFrame:
    """V8: the first n accounts alphabetically (the set to chart)."""
    return df.select(qcol(account).alias("Account")).where(F.col("Account").isNotNull()).distinct() \
        .orderBy("Account").limit(n)


def first_accounts_series(df: DataFrame, n: int = 20, account: str = "Account", date: str = "Date") -> DataFrame:
    """V8 + V3: the series of the first n accounts (the n-row key set is broadcast)."""
    keys = F.broadcast(first_accounts(df, n, account))
    return account_series(df, keys, account, date)


def units_vs_base(df: DataFrame, account: str = "Account") -> DataFrame:
    """V9 per account over all its rows: min, max, mean, sum of units and base units, whether
    the two columns are identical, and |Σunits − Σbase| / Σunits in %."""
    cols = metric_columns(df.columns)
    u, b = qcol(cols["units"]).cast("double"), qcol(cols["base_units"]).cast("double")
    g = df.groupBy(qcol(account).alias("Account")).agg(
        F.min(u).alias("units_min"), F.max(u).alias("units_max"), F.avg(u).alias("units_mean"),
        F.sum(u).alias("units_sum"), F.min(b).alias("base_min"), F.max(b).alias("base_max"),
        F.avg(b).alias("base_mean"), F.sum(b).alias("base_sum"), F.every(u.eqNullSafe(b)).alias("identical"))
    return g.select("*", F.try_divide(F.abs(F.col("units_sum") - F.col("base_sum")) * 100.0, F.col("units_sum"))
                    .alias("diff_pct"))
