"""Equal-length calendar periods.

period = floor(elapsed_whole_days(anchor, date) / (7·weeks)) + 1, where the anchor is the
minimum date over the frame.  The anchor is a one-row aggregate computed once and passed
into the plan as a literal, so the row-level plan stays a pure projection (no cross join,
no shuffle) and filters below it still push into the scan.  Pass ``anchor=`` explicitly to
share one anchor between differently filtered frames.

Elapsed days are ``timestampdiff(DAY, …)`` (whole 24-hour days, like pandas ``.dt.days``),
not ``datediff`` (calendar days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctlens.functions.columns import qcol

# Candidate period lengths in weeks, and the minimum complete periods.
CANDIDATE_WEEKS = [4, 8, 12, 13]
MIN_PERIODS = 3


class PeriodError(ValueError):
    """No valid dates, or a strict parse failed."""


def _as_timestamp(df: DataFrame, date: str, strict: bool) -> Column:
    dt = df.schema[date].dataType
    c = qcol(date)
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, (T.TimestampType, T.DateType)):
        # a zoned timestamp counts by its wall clock in the session's zone, rows and anchor alike
        return c.cast("timestamp_ntz")
    return F.to_timestamp_ntz(c) if strict else F.try_to_timestamp(c).cast("timestamp_ntz")


def date_anchor(df: DataFrame, date: str = "Date", strict: bool = False):
    """The minimum valid date (one-row aggregate job).  Raises when there is none."""
    mn = df.select(_as_timestamp(df, date, strict).alias("d")).agg(F.min("d")).first()[0]
    if mn is None:
        raise PeriodError(f"No valid dates found in column '{date}'")
    return mn


def _anchor_lit(anchor) -> Column:
    """The anchor as a wall-clock literal: an ISO string cast to timestamp_ntz, so neither the
    Python process's nor the session's time zone can shift it."""
    text = anchor.isoformat(sep=" ") if hasattr(anchor, "isoformat") else str(anchor)
    return F.lit(text).cast("timestamp_ntz")


def _period_expr(ts: Column, anchor, weeks: int) -> Column:
    a = _anchor_lit(anchor)
    return F.floor(F.timestamp_diff("DAY", a, ts) / F.lit(7 * weeks)) + 1


def create_time_periods(df: DataFrame, date: str = "Date", weeks: int = 13,
                        out: str = "Time_Period", anchor=None) -> DataFrame:
    """Strict parse; a missing date gives a missing period.  Output is bigint."""
    ts = _as_timestamp(df, date, strict=True)
    anchor = date_anchor(df, date, strict=True) if anchor is None else anchor
    return df.withColumn(out, _period_expr(ts, anchor, weeks).cast("long"))


def create_equal_periods(df: DataFrame, date: str = "Date", weeks: int = 13,
                         out: str = "Time_Period", anchor=None) -> DataFrame:
    """T2 (the one the application uses): coerce bad dates to missing, drop them, floor at 1,
    integer output; error when no date is valid."""
    ts = _as_timestamp(df, date, strict=False)
    anchor = date_anchor(df, date, strict=False) if anchor is None else anchor
    kept = df.withColumn("__ts", ts).where(F.col("__ts").isNotNull())
    if not isinstance(df.schema[date].dataType, (T.TimestampType, T.TimestampNTZType)):
        kept = kept.withColumn(date, F.col("__ts"))
    return (kept.withColumn(out, F.greatest(F.lit(1), _period_expr(F.col("__ts"), anchor, weeks)).cast("int"))
            .drop("__ts"))


def period_distribution(df: DataFrame, period: str, date: str = "Date") -> DataFrame:
    """First date, last date and row count per period."""
    return (df.groupBy(qcol(period).alias("Period"))
            .agg(F.min(qcol(date)).alias("Start_Date"), F.max(qcol(date)).alias("End_Date"),
                 F.count(F.lit(1)).alias("Num_Records")))


def _span(df: DataFrame, date: str) -> DataFrame:
    ts = _as_timestamp(df, date, strict=True)
    return df.agg(F.min(ts).alias("mn"), F.max(ts).alias("mx")).select(
        "mn", "mx", F.timestamp_diff("DAY", F.col("mn"), F.col("mx")).alias("total_days"))


def complete_periods(total_days: Column, weeks) -> Column:
    """int(total_days / 7 / weeks) — the span *without* the +1 day."""
    return F.floor(total_days / F.lit(7.0) / weeks).cast("int")


def period_coverage_table(df: DataFrame, date: str = "Date", weeks: int = 13,
                          min_periods: int = MIN_PERIODS) -> DataFrame:
    """T4 table: Period, Start_Date, End_Date, Num_Records, Days (inclusive), Weeks (1 dp),
    Expected_Weeks — empty when the span holds fewer than ``min_periods`` complete periods.

    The span is a one-row aggregate job; the table itself is one grouped aggregate."""
    s = _span(df, date).first()
    valid = s["mn"] is not None and int((s["total_days"] or 0) / 7 / weeks) >= min_periods
    ts = _as_timestamp(df, date, strict=True)
    rows = df.select(ts.alias("__d")).where(F.col("__d").isNotNull())
    if not valid:
        rows = rows.where(F.lit(False))
    anchor = s["mn"] if s["mn"] is not None else "1970-01-01"
    per = rows.select("__d", _period_expr(F.col("__d"), anchor, weeks).cast("long").alias("Period"))
    g = per.groupBy("Period").agg(F.min("__d").alias("Start_Date"), F.max("__d").alias("End_Date"),
                                 F.count(F.lit(1)).alias("Num_Records"))
    days = (F.timestamp_diff("DAY", F.col("Start_Date"), F.col("End_Date")) + 1).cast("long")
    return g.select("Period", "Start_Date", "End_Date", "Num_Records", days.alias("Days"),
                    F.round(days / F.lit(7.0), 1).alias("Weeks"),
                    F.lit(weeks).cast("int").alias("Expected_Weeks"))


def validate_period_coverage(df: DataFrame, date: str = "Date", weeks: int = 13,
                             min_periods: int = MIN_PERIODS):
    """T4 as a decision: (is_valid, message, table or None)."""
    s = _span(df, date).first()
    total_days = s["total_days"] or 0
    total_weeks = total_days / 7
    expected = int(total_weeks / weeks)
    if expected < min_periods:
        return (False, f"{total_weeks:.1f} weeks hold {expected} periods of {weeks} weeks; {min_periods} are needed", None)
    return (True, f"{total_weeks:.1f} weeks hold {expected} periods of {weeks} weeks",
            period_coverage_table(df, date, weeks, min_periods))


def recommended_period_lengths(df: DataFrame, date: str = "Date") -> DataFrame:
    """T5: candidates 4, 8, 12, 13 weeks kept when they give ≥ 3 complete periods;
    ``recommended`` when 4–10.  One min/max aggregate, then an explode of the candidates."""
    span = _span(df, date)
    cand = span.select(F.explode(F.array(*[F.lit(w) for w in CANDIDATE_WEEKS])).alias("weeks"), "total_days")
    n = complete_periods(F.col("total_days"), F.col("weeks"))
    return (cand.select(F.col("weeks").cast("int"), n.alias("num_periods"))
            .where(F.col("num_periods") >= MIN_PERIODS)
            .select("weeks", "num_periods", F.lit(True).alias("is_valid"),
                    F.col("num_periods").between(4, 10).alias("recommended"),
                    F.format_string("%d periods of %d weeks", "num_periods", "weeks").alias("message")))


def calendar_boundaries(df: DataFrame, date: str = "Date", weeks: int = 13) -> DataFrame:
    """Consecutive N-week ranges from the first to the last date (last one clipped), one row
    per period; dates as ``yyyy-MM-dd`` strings, Days inclusive, Weeks 1 dp."""
    n_days = 7 * weeks
    span = _span(df, date).where(F.col("mn").isNotNull())
    last = F.floor(F.timestamp_diff("SECOND", F.col("mn"), F.col("mx")) / F.lit(n_days * 86400))
    p = span.select("mn", "mx", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("p"))
    start = F.expr(f"timestampadd(DAY, p * {n_days}, mn)")
    p = p.select(F.col("p"), start.alias("s"), "mx")
    end = F.least(F.expr(f"timestampadd(DAY, {n_days - 1}, s)"), F.col("mx"))
    p = p.select("p", "s", end.alias("e"))
    days = (F.timestamp_diff("DAY", F.col("s"), F.col("e")) + 1).cast("long")
    return p.select((F.col("p") + 1).cast("int").alias("Period"),
                    F.date_format("s", "yyyy-MM-dd").alias("Start_Date"),
                    F.date_format("e", "yyyy-MM-dd").alias("End_Date"),
                    days.alias("Days"), F.round(days / F.lit(7.0), 1).alias("Weeks"))


def calendar_summary(boundaries: DataFrame, weeks: int = 13) -> DataFrame:
    """T6 summary: total, full (Weeks ≥ 0.95·N), last-period weeks, short flag (< 0.8·N)."""
    return boundaries.agg(
        F.count(F.lit(1)).alias("total_periods"),
        F.count_if(F.col("Weeks") >= F.lit(weeks * 0.95)).alias("full_periods"),
        F.max_by("Weeks", "Period").alias("last_period_weeks"),
    ).select("*", (F.col("last_period_weeks") < F.lit(weeks * 0.8)).alias("last_is_short"))
