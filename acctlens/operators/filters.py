"""Business filters.

All active filters are AND-ed into **one** predicate so Catalyst can combine them and push
them into the Parquet scan.  The summary (F8) is computed in a single pass over the
unfiltered frame with ``count_if(predicate)`` instead of counting two frames.

Null semantics follow the reference: a missing value fails every equality / threshold filter,
but survives the zero-sales exclusion (``NaN != 0`` is true in pandas) — hence the null-safe
comparison in F6.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctlens.functions.columns import find_column, qcol

# The aliases each filter accepts, in priority order.
LOWER_ALIASES = ("Lower",)
COT_ALIASES = ("COT", "Channel of Trade")
ACV_ALIASES = ("ACV Weighted Distribution", "ACV_Weighted_Distribution", "ACV")
PROMO_ALIASES = ("Auto_Promo_Code", "Auto Promo Code", "Auto.Promo.Code")
UNIT_SALES_ALIASES = ("Unit_Sales", "Unit Sales", "Unit.Sales", "UnitSales")


class FilterError(ValueError):
    """A filter column is missing or nothing survives filtering."""


@dataclass(frozen=True)
class FilterSpec:
    lower: int | None = None
    cot: str | None = None
    acv_threshold: float | None = None
    auto_promo_code: int | None = None
    exclude_zero_sales: bool = False

    @property
    def active(self) -> bool:
        return any(v is not None for v in (self.lower, self.cot, self.acv_threshold,
                                           self.auto_promo_code)) or self.exclude_zero_sales


def filter_predicate(df: DataFrame, spec: FilterSpec) -> Column:
    """F2–F6 as one boolean Column (true = keep).  Column lookup is F1 (schema only)."""
    try:
        preds: list[Column] = []
        if spec.lower is not None:
            preds.append(qcol(find_column(df, *LOWER_ALIASES)) == F.lit(spec.lower))
        if spec.cot is not None:
            preds.append(qcol(find_column(df, *COT_ALIASES)) == F.lit(spec.cot))
        if spec.acv_threshold is not None:
            preds.append(qcol(find_column(df, *ACV_ALIASES)) >= F.lit(spec.acv_threshold))
        if spec.auto_promo_code is not None:
            preds.append(qcol(find_column(df, *PROMO_ALIASES)) == F.lit(spec.auto_promo_code))
        if spec.exclude_zero_sales:
            preds.append(~qcol(find_column(df, *UNIT_SALES_ALIASES)).eqNullSafe(F.lit(0)))
    except ValueError as e:
        raise FilterError(str(e)) from None
    if not preds:
        return F.lit(True)
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    # A plain conjunction, so Catalyst can split it and push each conjunct to its own scan.
    # NULL means "drop" already: ``filter`` and ``count_if`` keep / count only true.
    return out


def apply_filters(df: DataFrame, spec: FilterSpec, check_empty: bool = False) -> DataFrame:
    """AND of the active filters.  ``check_empty`` runs a cheap ``isEmpty`` job and raises
    like the reference when nothing remains (off by default: it forces a job)."""
    out = df.filter(filter_predicate(df, spec)) if spec.active else df
    if check_empty and out.isEmpty():
        raise FilterError("No data remains after applying filters")
    return out


def filter_summary(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """F8: rows before / after / removed and % removed (2 dp; 0.0 for empty input), one pass."""
    pred = filter_predicate(df, spec)
    return (df.agg(F.count(F.lit(1)).alias("rows_original"), F.count_if(pred).alias("rows_filtered"))
            .select("rows_original", "rows_filtered",
                    (F.col("rows_original") - F.col("rows_filtered")).alias("rows_removed"),
                    F.coalesce(F.round(F.try_divide((F.col("rows_original") - F.col("rows_filtered")) * 100.0,
                                                    F.col("rows_original")), 2), F.lit(0.0))
                    .alias("percent_removed")))


def channel_values(df: DataFrame) -> DataFrame:
    """distinct channel-of-trade values (NULL excluded), sorted."""
    c = find_column(df, *COT_ALIASES)
    return df.select(qcol(c).alias("COT")).where(F.col("COT").isNotNull()).distinct().orderBy("COT")


def survivors(df: DataFrame, period: str, account: str = "Account") -> DataFrame:
    """what survives filtering — rows, distinct periods, distinct accounts (one agg)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(qcol(period)).alias("n_periods"),
                  F.count_distinct(qcol(account)).alias("n_accounts"))
