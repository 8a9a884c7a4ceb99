"""The registered queries (one per SURVEY §2 operator) and their DuckDB oracles.

Every query reads the driver's tables (through ``sales_view`` where the operator needs the
sales shape) over the whole tables; nothing is sampled, capped or subset.  Computed columns
carry the same alias in Spark and in the oracle SQL.  Doubles that come out of arithmetic
are rounded to 6 decimals on both sides so the value hashes are comparable.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctlens.operators import crossval as CV
from acctlens.operators import features as FE
from acctlens.operators import filters as FL
from acctlens.operators import periods as PE
from acctlens.operators import regress as RG
from acctlens.operators import residuals as RS
from acctlens.operators import decide as DC
from acctlens.operators import density as DN
from acctlens.operators import forest as FO
from acctlens.operators import hdbscan as HD
from acctlens.operators import validity as VA
from acctlens.operators import results as RE
from acctlens.operators import series as SE
from acctlens.functions.median import group_quantile
from acctlens.session import cut_lineage, scratch_path
from acctlens.settings import DetectSpec, ModelSpec, group_count
from acctlens.sources import loader as LD
from acctlens.sources.sales import sales_view, sales_view_sql, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


SV = sales_view_sql()
SVC = sales_view_sql("customer")
# The saved-run filter setting mapped onto the driver tables (FIXTURES.md B).
SPEC = FL.FilterSpec(lower=1, cot="HOUSEHOLD", acv_threshold=10, auto_promo_code=0, exclude_zero_sales=True)
SPEC_SQL = ("Lower = 1 AND COT = 'HOUSEHOLD' AND ACV_Weighted_Distribution >= 10 "
            "AND Auto_Promo_Code = 0 AND Unit_Sales IS DISTINCT FROM 0")
WEEKS = 13


def _periods_sql(src: str, weeks: int = WEEKS, date: str = "Date") -> str:
    return (f"(SELECT s.*, CAST(greatest(1, floor(date_sub('day', m.mn, s.{date}) / {7 * weeks}) + 1) AS INTEGER)"
            f" AS Time_Period FROM {src} s, (SELECT min({date}) mn FROM {src}) m WHERE s.{date} IS NOT NULL)")


# ---------------------------------------------------------------- S: sources and profiling

@register("s1_load", "SELECT * FROM lineitem")
def q_s1(spark, d):
    return LD.load_data(spark, f"{d}/lineitem.parquet")


_S3_COLS = [("Account", "string"), ("Date", "timestamp_ntz"), ("Lower", "int"), ("COT", "string"),
            ("ACV_Weighted_Distribution", "double"), ("Auto_Promo_Code", "int"), ("Unit_Sales", "double"),
            ("Dollar_Sales", "double"), ("Auto_Base_Units", "double"), ("Auto_Base_Dollars", "double"),
            ("Price_Bucket_Quarter", "string")]


@register("s3_column_info", " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM {SV}"
    for i, (c, t) in enumerate(_S3_COLS)))
def q_s3(spark, d):
    return LD.column_info(sales_view(spark, d))


@register("s4_overview", f"""
SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns, count(DISTINCT Account) AS n_accounts,
       date_sub('day', min(Date), max(Date)) AS date_span_days,
       CAST({' + '.join(f'count({c})' for c, _ in _S3_COLS)} AS BIGINT) AS non_null_cells,
       round((count(*) * 11 - ({' + '.join(f'count({c})' for c, _ in _S3_COLS)})) * 100.0 / (count(*) * 11), 2)
         AS null_pct
FROM {SV}""")
def q_s4(spark, d):
    return LD.dataset_overview(sales_view(spark, d))


_ALL = [c for c, _ in _S3_COLS]


@register("s5_preview", f"SELECT * FROM {SV} ORDER BY {', '.join(_ALL)} LIMIT 20")
def q_s5(spark, d):
    return LD.preview(sales_view(spark, d), _ALL, 20)


# ---------------------------------------------------------------- F: filters

@register("f2_lower", f"SELECT * FROM {SV} WHERE Lower = 1")
def q_f2(spark, d):
    return FL.apply_filters(sales_view(spark, d), FL.FilterSpec(lower=1))


@register("f3_cot", f"SELECT * FROM {SV} WHERE COT = 'HOUSEHOLD'")
def q_f3(spark, d):
    return FL.apply_filters(sales_view(spark, d), FL.FilterSpec(cot="HOUSEHOLD"))


@register("f4_acv", f"SELECT * FROM {SV} WHERE ACV_Weighted_Distribution >= 10")
def q_f4(spark, d):
    return FL.apply_filters(sales_view(spark, d), FL.FilterSpec(acv_threshold=10))


@register("f5_promo", f"SELECT * FROM {SV} WHERE Auto_Promo_Code = 0")
def q_f5(spark, d):
    return FL.apply_filters(sales_view(spark, d), FL.FilterSpec(auto_promo_code=0))


@register("f6_nonzero_sales", f"SELECT * FROM {SV} WHERE Unit_Sales IS DISTINCT FROM 0")
def q_f6(spark, d):
    return FL.apply_filters(sales_view(spark, d), FL.FilterSpec(exclude_zero_sales=True))


@register("f7_apply_filters", f"SELECT * FROM {SV} WHERE {SPEC_SQL}")
def q_f7(spark, d):
    return FL.apply_filters(sales_view(spark, d), SPEC)


@register("f8_filter_summary", f"""
SELECT count(*) AS rows_original, count(*) FILTER (WHERE {SPEC_SQL}) AS rows_filtered,
       count(*) - count(*) FILTER (WHERE {SPEC_SQL}) AS rows_removed,
       coalesce(round((count(*) - count(*) FILTER (WHERE {SPEC_SQL})) * 100.0 / nullif(count(*), 0), 2), 0.0)
         AS percent_removed
FROM {SV}""")
def q_f8(spark, d):
    return FL.filter_summary(sales_view(spark, d), SPEC)


@register("f9_channels", f"SELECT DISTINCT COT FROM {SV} WHERE COT IS NOT NULL")
def q_f9(spark, d):
    return FL.channel_values(sales_view(spark, d))


@register("f10_survivors", f"""
SELECT count(*) AS n_rows, count(DISTINCT Time_Period) AS n_periods, count(DISTINCT Account) AS n_accounts
FROM {_periods_sql(SV)} WHERE {SPEC_SQL}""")
def q_f10(spark, d):
    sv = PE.create_equal_periods(sales_view(spark, d), "Date", WEEKS)
    return FL.survivors(FL.apply_filters(sv, SPEC), "Time_Period")


# ---------------------------------------------------------------- T: time periods

@register("t1_time_periods", f"""
SELECT s.*, CAST(floor(date_sub('day', m.mn, s.Date) / 91) + 1 AS BIGINT) AS Time_Period
FROM {SV} s, (SELECT min(Date) mn FROM {SV}) m""")
def q_t1(spark, d):
    return PE.create_time_periods(sales_view(spark, d), "Date", WEEKS)


@register("t1_events_weekly", """
SELECT e.*, CAST(floor(date_sub('day', m.mn, e.ts) / 7) + 1 AS BIGINT) AS Time_Period
FROM events e, (SELECT min(ts) mn FROM events) m""")
def q_t1e(spark, d):
    return PE.create_time_periods(table(spark, d, "events"), "ts", 1)


@register("t2_equal_periods", f"SELECT * FROM {_periods_sql(SV)}")
def q_t2(spark, d):
    return PE.create_equal_periods(sales_view(spark, d), "Date", WEEKS)


@register("t3_period_distribution", f"""
SELECT Time_Period AS Period, min(Date) AS Start_Date, max(Date) AS End_Date, count(*) AS Num_Records
FROM {_periods_sql(SV)} GROUP BY Time_Period""")
def q_t3(spark, d):
    return PE.period_distribution(PE.create_equal_periods(sales_view(spark, d), "Date", WEEKS), "Time_Period")


def _coverage_sql(tbl: str, date: str, weeks: int) -> str:
    return f"""
WITH m AS (SELECT min({date}) mn, max({date}) mx FROM {tbl}),
p AS (SELECT CAST(floor(date_sub('day', m.mn, t.{date}) / {7 * weeks}) + 1 AS BIGINT) AS Period, t.{date} d
      FROM {tbl} t, m WHERE t.{date} IS NOT NULL
        AND floor(date_sub('day', m.mn, m.mx) / 7.0 / {weeks}) >= 3),
g AS (SELECT Period, min(d) Start_Date, max(d) End_Date, count(*) Num_Records FROM p GROUP BY Period)
SELECT Period, Start_Date, End_Date, Num_Records, CAST(date_sub('day', Start_Date, End_Date) + 1 AS BIGINT) AS Days,
       round((date_sub('day', Start_Date, End_Date) + 1) / 7.0, 1) AS Weeks, CAST({weeks} AS INTEGER) AS Expected_Weeks
FROM g"""


@register("t4_period_coverage", _coverage_sql("lineitem", "l_shipdate", WEEKS))
def q_t4(spark, d):
    return PE.period_coverage_table(table(spark, d, "lineitem"), "l_shipdate", WEEKS)


@register("t4_period_coverage_events", _coverage_sql("events", "ts", WEEKS))
def q_t4e(spark, d):
    return PE.period_coverage_table(table(spark, d, "events"), "ts", WEEKS)


@register("t4_period_coverage_events_short", _coverage_sql("events", "ts", 1))
def q_t4e1(spark, d):
    return PE.period_coverage_table(table(spark, d, "events"), "ts", 1)


@register("t2_equal_periods_zoned", f"""
SELECT l_orderkey, l_linenumber, CAST(greatest(1, floor(date_sub('day', m.mn, l.l_shipdate) / {7 * WEEKS}) + 1) AS INTEGER) AS Time_Period
FROM lineitem l, (SELECT min(l_shipdate) mn FROM lineitem) m""")
def q_t2z(spark, d):
    """Dates as instants: they count by their wall clock in the session's zone."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("Date"))
    return PE.create_equal_periods(li, "Date", WEEKS).drop("Date")


def _recommend_sql(tbl: str, date: str) -> str:
    return f"""
SELECT CAST(w AS INTEGER) AS weeks, CAST(floor(date_sub('day', min({date}), max({date})) / 7.0 / w) AS INTEGER) AS num_periods,
       true AS is_valid,
       floor(date_sub('day', min({date}), max({date})) / 7.0 / w) BETWEEN 4 AND 10 AS recommended,
       concat(CAST(CAST(floor(date_sub('day', min({date}), max({date})) / 7.0 / w) AS INTEGER) AS VARCHAR), ' periods of ',
              CAST(w AS VARCHAR), ' weeks') AS message
FROM {tbl}, (SELECT unnest([4, 8, 12, 13]) w) c GROUP BY w
HAVING floor(date_sub('day', min({date}), max({date})) / 7.0 / w) >= 3"""


@register("t5_recommended_lengths", _recommend_sql("lineitem", "l_shipdate"))
def q_t5(spark, d):
    return PE.recommended_period_lengths(table(spark, d, "lineitem"), "l_shipdate")


@register("t5_recommended_lengths_events", _recommend_sql("events", "ts"))
def q_t5e(spark, d):
    return PE.recommended_period_lengths(table(spark, d, "events"), "ts")


def _calendar_sql(tbl: str, date: str, weeks: int) -> str:
    n = 7 * weeks
    return f"""
WITH m AS (SELECT min({date}) mn, max({date}) mx FROM {tbl}),
p AS (SELECT r.p, m.mn + to_days(CAST(r.p * {n} AS INTEGER)) AS s, m.mx FROM m,
      LATERAL (SELECT unnest(range(0, CAST(floor(epoch(m.mx - m.mn) / {n * 86400}) AS BIGINT) + 1)) AS p) r),
q AS (SELECT p, s, least(s + to_days({n - 1}), mx) AS e FROM p)
SELECT CAST(p + 1 AS INTEGER) AS Period, strftime(s, '%Y-%m-%d') AS Start_Date, strftime(e, '%Y-%m-%d') AS End_Date,
       CAST(date_sub('day', s, e) + 1 AS BIGINT) AS Days, round((date_sub('day', s, e) + 1) / 7.0, 1) AS Weeks
FROM q"""


@register("t6_calendar_boundaries", _calendar_sql("lineitem", "l_shipdate", WEEKS))
def q_t6(spark, d):
    return PE.calendar_boundaries(table(spark, d, "lineitem"), "l_shipdate", WEEKS)


@register("t6_calendar_boundaries_weekly", _calendar_sql("lineitem", "l_shipdate", 1))
def q_t6w(spark, d):
    return PE.calendar_boundaries(table(spark, d, "lineitem"), "l_shipdate", 1)


@register("t6_calendar_summary", f"""
WITH b AS ({_calendar_sql("lineitem", "l_shipdate", WEEKS)})
SELECT count(*) AS total_periods, count(*) FILTER (WHERE Weeks >= {WEEKS * 0.95}) AS full_periods,
       arg_max(Weeks, Period) AS last_period_weeks, arg_max(Weeks, Period) < {WEEKS * 0.8} AS last_is_short FROM b""")
def q_t6s(spark, d):
    return PE.calendar_summary(PE.calendar_boundaries(table(spark, d, "lineitem"), "l_shipdate", WEEKS), WEEKS)


# ---------------------------------------------------------------- R / K: model and cross-validation

def rounded(df: DataFrame, nd: int = 6) -> DataFrame:
    """Round every double column (same rounding as the oracle's ``round(x, 6)``)."""
    return df.select(*[F.round(F.col(f.name), nd).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


# The saved run's model (target, one continuous, the account effect), k and weight.
MODEL = ModelSpec("Auto_Base_Units", ("ACV_Weighted_Distribution",), ("Account",))
MODEL2 = ModelSpec("Auto_Base_Units", ("ACV_Weighted_Distribution",), ("Account", "Price_Bucket_Quarter"))
K = 5
WEIGHT = "Auto_Base_Units"


def dated_sales(spark, d, account_key: str = "supplier", filters=None):
    sv = PE.create_equal_periods(sales_view(spark, d, account_key), "Date", WEEKS)
    return sv if filters is None else FL.apply_filters(sv, filters)


def model_frame(spark, d, spec: ModelSpec = MODEL, account_key: str = "supplier", filters=None):
    """The model frame over every row; ``filters`` for the saved run's own chain.  Without them the model's
    columns are written with their dates, so the tables are joined once for the anchor and the model."""
    if filters is not None:
        return FE.prepare(dated_sales(spark, d, account_key, filters), spec, "Account", "Time_Period", WEIGHT)
    columns = list(dict.fromkeys(["Account", "Date", WEIGHT, *spec.columns]))
    sv = cut_lineage(sales_view(spark, d, account_key).select(*columns))
    return FE.prepare(PE.create_equal_periods(sv, "Date", WEEKS), spec, "Account", "Time_Period", WEIGHT, written=True)


def _mf_sql(src: str = SV, where: str = "TRUE") -> str:
    return f"""(SELECT Account AS account, Time_Period AS period, coalesce(CAST({WEIGHT} AS DOUBLE), 1.0) AS weight,
        ln(greatest(Auto_Base_Units, 1e-6)) AS y, ln(greatest(ACV_Weighted_Distribution, 1e-6)) AS x, Account AS a
    FROM {_periods_sql(src)} WHERE {where}
      AND Auto_Base_Units IS NOT NULL AND ACV_Weighted_Distribution IS NOT NULL AND Account IS NOT NULL)"""


MF = _mf_sql()


def _folds_sql(ks: list[int], mf: str = MF) -> str:
    return f"""
pc AS (SELECT period per, count(*) c FROM {mf} GROUP BY period),
ks AS (SELECT unnest({list(ks)}) k),
gq AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY c DESC, per DESC) rn, per, c FROM pc, ks),
rr AS (SELECT k, CAST(0 AS BIGINT) rn, list_transform(range(k), lambda i: CAST(0 AS BIGINT)) AS ld,
              CAST(NULL AS INTEGER) per, CAST(0 AS BIGINT) f FROM ks
       UNION ALL
       SELECT rr.k, gq.rn,
              list_transform(range(1, rr.k + 1), lambda i: rr.ld[i] + CASE WHEN i = list_position(rr.ld, list_min(rr.ld)) THEN gq.c ELSE 0 END),
              gq.per, CAST(list_position(rr.ld, list_min(rr.ld)) AS BIGINT)
       FROM rr JOIN gq ON gq.k = rr.k AND gq.rn = rr.rn + 1),
folds AS (SELECT CAST(k AS INTEGER) k, per AS period, CAST(f AS INTEGER) fold FROM rr WHERE rn > 0)"""


def _cv_sql(ks: list[int], mf: str = MF) -> str:
    """Out-of-fold predictions for every (k, fold): within-group slope + group intercepts;
    a level missing from training takes the fold's baseline (smallest training level)."""
    return f"""WITH RECURSIVE {_folds_sql(ks, mf)},
d AS (SELECT m.*, fo.k, fo.fold FROM {mf} m JOIN folds fo ON m.period = fo.period),
kf AS (SELECT DISTINCT k, fold FROM folds),
tr AS (SELECT kf.k, kf.fold, d.a, d.x, d.y FROM d JOIN kf ON d.k = kf.k AND d.fold <> kf.fold),
gm AS (SELECT k, fold, a, avg(x) mx, avg(y) my FROM tr GROUP BY k, fold, a),
sl AS (SELECT tr.k, tr.fold, sum((tr.x - gm.mx) * (tr.y - gm.my)) / sum((tr.x - gm.mx) * (tr.x - gm.mx)) b
       FROM tr JOIN gm ON gm.k = tr.k AND gm.fold = tr.fold AND gm.a = tr.a GROUP BY tr.k, tr.fold),
base AS (SELECT k, fold, min(a) a0 FROM gm GROUP BY k, fold),
pred AS (SELECT d.*, coalesce(gm.my, mb.my) + sl.b * (d.x - coalesce(gm.mx, mb.mx)) AS predicted
         FROM d JOIN sl ON sl.k = d.k AND sl.fold = d.fold
         LEFT JOIN gm ON gm.k = d.k AND gm.fold = d.fold AND gm.a = d.a
         JOIN base ON base.k = d.k AND base.fold = d.fold
         JOIN gm mb ON mb.k = d.k AND mb.fold = d.fold AND mb.a = base.a0)"""


@register("r1_negative_counts", f"""
SELECT CAST(count(*) FILTER (WHERE Auto_Base_Units < 0) AS BIGINT) AS neg_target,
       CAST(count(*) FILTER (WHERE ACV_Weighted_Distribution < 0) AS BIGINT) AS neg_predictors FROM {SV}""")
def q_r1(spark, d):
    return FE.negative_counts(sales_view(spark, d), MODEL)


@register("r4_model_frame", f"SELECT account, period, round(weight, 6) AS weight, round(y, 6) AS y, "
                            f"round(x, 6) AS x0, a AS g FROM {MF}")
def q_r4(spark, d):
    m, _ = model_frame(spark, d)
    return rounded(m)


@register("r4_dropped_rows", f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE Auto_Base_Units IS NULL OR ACV_Weighted_Distribution IS NULL
   OR Account IS NULL) AS n_dropped FROM {SV}""")
def q_r4d(spark, d):
    return FE.dropped_rows(sales_view(spark, d), MODEL)


@register("r6_dummy_levels", f"""
SELECT 'Price_Bucket_Quarter' AS "column", Price_Bucket_Quarter AS level,
       Price_Bucket_Quarter = min(Price_Bucket_Quarter) OVER () AS is_baseline
FROM (SELECT DISTINCT Price_Bucket_Quarter FROM {SV})""")
def q_r6(spark, d):
    return FE.dummy_table(sales_view(spark, d), ["Price_Bucket_Quarter"])


def _variant(name: str, spec: ModelSpec, y: str, x: str, keep: str):
    """A branch of the model frame: R3 (add a constant), an unlogged target, R5 (impute)."""
    @register(name, f"""SELECT Account AS account, Time_Period AS period, round({y}, 6) AS y, round({x}, 6) AS x0
        FROM {_periods_sql(SV)} WHERE {keep}""")
    def query(spark, d):
        sv = dated_sales(spark, d)
        if not spec.drop_na:
            sv = sv.withColumn("Unit_Sales", F.when(F.col("Unit_Sales") != 0, F.col("Unit_Sales")))
        m, _ = FE.prepare(sv, spec, "Account", "Time_Period")
        return rounded(m.select("account", "period", "y", "x0"))


_variant("r3_add_constant", ModelSpec("Unit_Sales", ("ACV_Weighted_Distribution",), ("Account",), handle_zeros="add_constant"),
         "ln(Unit_Sales + 1)", "ln(ACV_Weighted_Distribution + 1)", "TRUE")
_variant("r2_unlogged_target", ModelSpec("Unit_Sales", ("ACV_Weighted_Distribution",), ("Account",), log_transform=False),
         "Unit_Sales", "ln(greatest(ACV_Weighted_Distribution, 1e-6))", "TRUE")
_variant("r5_imputed_predictor", ModelSpec("Auto_Base_Units", ("Unit_Sales",), ("Account",), drop_na=False),
         "ln(greatest(Auto_Base_Units, 1e-6))", "CASE WHEN coalesce(Unit_Sales, 0) = 0 THEN 0.0 ELSE ln(greatest(Unit_Sales, 1e-6)) END", "TRUE")


_FIT_ALL_SQL = f"""WITH gm AS (SELECT a, avg(x) mx, avg(y) my FROM {MF} GROUP BY a),
sl AS (SELECT sum((m.x - gm.mx) * (m.y - gm.my)) / sum((m.x - gm.mx) * (m.x - gm.mx)) b
       FROM {MF} m JOIN gm ON gm.a = m.a)"""


@register("r7_fit", f"""{_FIT_ALL_SQL}
SELECT gm.a AS g, round(gm.my - sl.b * gm.mx, 6) AS alpha, round(sl.b, 6) AS slope FROM gm, sl""")
def q_r7(spark, d):
    m, design = model_frame(spark, d)
    fit, _ = RG.fit_all(m, design)
    return rounded(fit.alpha.select("g", "alpha", F.lit(float(fit.coef[(0, 0)][0])).alias("slope")))


@register("r8_predict", f"""{_FIT_ALL_SQL}
SELECT m.account, m.period, round(m.y, 6) AS actual, round(gm.my + sl.b * (m.x - gm.mx), 6) AS predicted,
       round(m.y - (gm.my + sl.b * (m.x - gm.mx)), 6) AS residual
FROM {MF} m JOIN gm ON gm.a = m.a, sl""")
def q_r8(spark, d):
    m, design = model_frame(spark, d)
    fit, test = RG.fit_all(m, design)
    s = RG.predict_rows(m, fit, test)
    return rounded(s.select("account", "period", F.col("y").alias("actual"), "predicted", "residual"))


@register("r9_in_sample_report", f"""{_FIT_ALL_SQL},
p AS (SELECT m.y, m.y - (gm.my + sl.b * (m.x - gm.mx)) AS r FROM {MF} m JOIN gm ON gm.a = m.a, sl)
SELECT count(*) AS n, round(avg(r * r), 6) AS mse, round(1 - sum(r * r) / (var_pop(y) * count(*)), 6) AS r2 FROM p""")
def q_r9(spark, d):
    m, design = model_frame(spark, d)
    return rounded(RG.in_sample_report(m, design))


@register("k1_fold_assignment", f"WITH RECURSIVE {_folds_sql([K])} SELECT * FROM folds")
def q_k1(spark, d):
    m, design = model_frame(spark, d)
    counts = m.groupBy("period").agg(F.count(F.lit(1)).alias("c"))
    return CV.fold_assignment(counts, [K])


@register("k1_fold_assignment_all_k", f"WITH RECURSIVE {_folds_sql(list(range(2, 11)))} SELECT * FROM folds")
def q_k1a(spark, d):
    m, design = model_frame(spark, d)
    counts = m.groupBy("period").agg(F.count(F.lit(1)).alias("c"))
    return CV.fold_assignment(counts, list(range(2, 11)))


@register("k2_group_count", f"SELECT count(DISTINCT period) AS n_groups, {K} <= count(DISTINCT period) AS feasible FROM {MF}")
def q_k2(spark, d):
    return group_count(dated_sales(spark, d), "Time_Period", K)


@register("k10_k_bounds", f"""
SELECT CAST(greatest(2, least(10, n)) AS INTEGER) AS upper, CAST(greatest(2, least({K}, greatest(2, least(10, n)))) AS INTEGER) AS chosen
FROM (SELECT floor(date_sub('day', min(l_shipdate), max(l_shipdate)) / 7.0 / {WEEKS}) n FROM lineitem)""")
def q_k10(spark, d):
    return CV.k_bounds_table(table(spark, d, "lineitem"), "l_shipdate", WEEKS, K)


_CV5 = _cv_sql([K])


@register("k3_cv_residuals", f"""{_CV5}
SELECT fold, account, round(y, 6) AS actual, round(predicted, 6) AS predicted, round(y - predicted, 6) AS residual,
       round(weight, 6) AS weight, period FROM pred""")
def q_k3(spark, d):
    m, design = model_frame(spark, d)
    return rounded(CV.run_cv(m, design, K).residuals)


_SUMMARY_SQL = f"""{_CV5},
fs AS (SELECT fold, count(*) n_test, sum((y - predicted) ^ 2) sse, var_pop(y) vy, avg(y - predicted) mr,
              stddev_pop(y - predicted) sr FROM pred GROUP BY fold),
tot AS (SELECT count(*) n FROM {MF}),
smry AS (SELECT fold, tot.n - n_test AS n_train, n_test, sse / n_test AS mse,
                CASE WHEN n_test < 2 THEN NULL WHEN vy * n_test <= 0 THEN (CASE WHEN sse <= 0 THEN 1.0 ELSE 0.0 END)
                     ELSE 1 - sse / (vy * n_test) END AS r2, mr AS mean_residual, sr AS std_residual FROM fs, tot)"""


@register("k6_fold_summary", f"""{_SUMMARY_SQL}
SELECT fold, n_train, n_test, round(mse, 6) AS mse, round(r2, 6) AS r2, round(mean_residual, 6) AS mean_residual,
       round(std_residual, 6) AS std_residual FROM smry""")
def q_k6(spark, d):
    m, design = model_frame(spark, d)
    return rounded(CV.fold_summary(CV.run_cv(m, design, K)))


@register("k5_cv_scores", f"""{_SUMMARY_SQL}
SELECT round(avg(mse), 6) AS mean_mse, round(stddev_pop(mse), 6) AS std_mse, round(avg(r2), 6) AS mean_r2,
       round(stddev_pop(r2), 6) AS std_r2 FROM smry""")
def q_k5(spark, d):
    m, design = model_frame(spark, d)
    return rounded(CV.cv_scores(CV.fold_summary(CV.run_cv(m, design, K))))


@register("k9_fold_mse_vs_mean", f"""{_SUMMARY_SQL}
SELECT fold, round(mse, 6) AS mse, round(avg(mse) OVER (), 6) AS mean_mse FROM smry""")
def q_k9(spark, d):
    m, design = model_frame(spark, d)
    return rounded(CV.fold_mse_vs_mean(CV.fold_summary(CV.run_cv(m, design, K))))


@register("k8_optimal_k", f"""{_cv_sql(list(range(2, 11)))},
fm AS (SELECT k, fold, avg((y - predicted) ^ 2) mse,
              CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) * count(*) <= 0 THEN 0.0
                   ELSE 1 - sum((y - predicted) ^ 2) / (var_pop(y) * count(*)) END r2 FROM pred GROUP BY k, fold),
pk AS (SELECT k, avg(mse) mean_mse, stddev_pop(mse) std_mse, avg(r2) mean_r2, stddev_pop(r2) std_r2 FROM fm GROUP BY k)
SELECT k, round(mean_mse, 6) AS mean_mse, round(std_mse, 6) AS std_mse, round(mean_r2, 6) AS mean_r2,
       round(std_r2, 6) AS std_r2, k = arg_min(k, (mean_mse, k)) OVER () AS best FROM pk""")
def q_k8(spark, d):
    m, design = model_frame(spark, d)
    return rounded(CV.find_optimal_k(m, design))


@register("k3_cv_residuals_two_effects", None)
def q_k3b(spark, d):
    """Account absorbed + price-bucket dummies: no closed form in SQL; rows-only check here,
    exactness is tested against a dense least-squares solve in tests/test_regression.py."""
    m, design = model_frame(spark, d, MODEL2)
    return rounded(CV.run_cv(m, design, K).residuals)




# ---------------------------------------------------------------- A: residual statistics per account

def _stats_sql(cv_sql: str = _CV5) -> str:
    return f"""{cv_sql},
res AS (SELECT account, y - predicted AS r, weight AS w FROM pred WHERE account IS NOT NULL),
m1 AS (SELECT account, sum(w) sw, sum(w * r) / sum(w) mu, count(*) cnt FROM res GROUP BY account),
m2 AS (SELECT res.account, sum(w * (r - mu) ^ 2) s2, sum(w * (r - mu) ^ 3) s3 FROM res JOIN m1 USING (account)
       GROUP BY res.account),
md AS (SELECT account, median(r) med FROM res GROUP BY account),
mad AS (SELECT res.account, median(abs(r - med)) mad FROM res JOIN md USING (account) GROUP BY res.account),
st AS (SELECT m1.account, mu, CASE WHEN sqrt(s2 / sw) < 1e-12 * greatest(1, abs(mu)) THEN 0.0 ELSE sqrt(s2 / sw) END sd,
              s3, sw, cnt, mad FROM m1 JOIN m2 USING (account) JOIN mad USING (account)),
st2 AS (SELECT account AS Account, mu AS w_mean_residual, sd AS w_std_residual,
               CASE WHEN sd > 0 THEN (s3 / sw) / (sd ^ 3) ELSE 0.0 END AS w_skew_residual, mad AS mad_residual,
               cnt AS "count" FROM st),
zz AS (SELECT avg(w_mean_residual) zm, stddev_pop(w_mean_residual) zs FROM st2),
stats AS (SELECT st2.*, CASE WHEN zs > 0 THEN (w_mean_residual - zm) / zs ELSE 0.0 END AS z_mean_residual
          FROM st2, zz)"""


def _feat_sql(cv_sql: str = _CV5) -> str:
    f = ["w_mean_residual", "z_mean_residual", "w_std_residual", "w_skew_residual"]
    aggs = ", ".join(f"avg({c}) m{i}, stddev_pop({c}) s{i}" for i, c in enumerate(f))
    cols = ", ".join(f"CASE WHEN s{i} > 0 THEN ({c} - m{i}) / s{i} ELSE {c} - m{i} END AS f{i}" for i, c in enumerate(f))
    return f"""{_stats_sql(cv_sql)},
mom AS (SELECT {aggs} FROM stats),
feat AS (SELECT Account, {cols} FROM stats, mom)"""


_STATS_COLS = ("Account, round(w_mean_residual, 6) AS w_mean_residual, round(w_std_residual, 6) AS w_std_residual, "
               "round(w_skew_residual, 6) AS w_skew_residual, round(mad_residual, 6) AS mad_residual, \"count\", "
               "round(z_mean_residual, 6) AS z_mean_residual")


def cv_account_stats(spark, d, spec: ModelSpec = MODEL, account_key: str = "supplier", filters=None):
    m, design = model_frame(spark, d, spec, account_key, filters)
    return RS.account_stats(CV.run_cv(m, design, K).residuals)


@register("a1_a7_account_stats", f"{_stats_sql()} SELECT {_STATS_COLS} FROM stats")
def q_a(spark, d):
    return rounded(cv_account_stats(spark, d))


@register("a8_feature_matrix", f"{_feat_sql()} SELECT Account, round(f0, 6) AS f0, round(f1, 6) AS f1, "
                               f"round(f2, 6) AS f2, round(f3, 6) AS f3 FROM feat")
def q_a8(spark, d):
    return rounded(RS.feature_matrix(cv_account_stats(spark, d)))




# ---------------------------------------------------------------- D: detection over accounts

_MEMO: dict = {}


def memo(spark, d, key, build):
    """Reuse an already materialised intermediate (checkpointed) within one session."""
    k = (id(spark), d, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def stats_of(spark, d):
    return memo(spark, d, "stats", lambda: cut_lineage(cv_account_stats(spark, d)))


def features_of(spark, d):
    return memo(spark, d, "feat", lambda: cut_lineage(RS.feature_matrix(stats_of(spark, d))))


def dbscan_of(spark, d):
    return memo(spark, d, "dbscan", lambda: DN.dbscan(features_of(spark, d), 5, 90, 5))


def exact_flags(spark, d):
    """Flags every engine can reproduce exactly: DBSCAN noise (D3) OR the D7 threshold
    applied to −k-distance (more isolated = lower score)."""
    def build():
        db = dbscan_of(spark, d)
        sc = db.flags.select("Account", (-F.col("kdist")).alias("score"))
        thr = FO.contamination_threshold(sc, "score", 0.10)
        acc = (stats_of(spark, d).join(db.flags.select("Account", "dbscan_outlier"), "Account")
               .join(sc.select("Account", (F.col("score") < F.lit(thr)).cast("int").alias("kdist_outlier")), "Account"))
        flag, typ = DC.combine(F.col("dbscan_outlier"), F.col("kdist_outlier"), "DBSCAN", "kdist")
        return cut_lineage(acc.select("*", flag.alias("outlier_flag"), typ.alias("outlier_type")))
    return memo(spark, d, "exact_flags", build)


def hdbscan_of(spark, d):
    return memo(spark, d, "hdbscan", lambda: cut_lineage(HD.hdbscan(features_of(spark, d), 5, 3)))


def forest_of(spark, d):
    return memo(spark, d, "forest", lambda: FO.isolation_forest(features_of(spark, d), 0.10, 100, 256, 42)[0])


def forest_types(spark, d):
    """D10 on DBSCAN's noise and the forest's flags."""
    def build():
        acc = stats_of(spark, d).join(dbscan_of(spark, d).flags.select("Account", "dbscan_outlier"), "Account").join(forest_of(spark, d), "Account")
        flag, typ = DC.combine(F.col("dbscan_outlier"), F.col("iforest_outlier"), "DBSCAN")
        return cut_lineage(acc.select("*", flag.alias("outlier_flag"), typ.alias("outlier_type")))
    return memo(spark, d, "forest_types", build)


def detection_of(spark, d):
    return memo(spark, d, "detect",
                lambda: DC.detect(stats_of(spark, d), DetectSpec(), hdbscan_flags=hdbscan_of(spark, d)))


_PAIRS_SQL = f"""{_feat_sql()},
pr AS (SELECT a.Account p, b.Account q,
              sqrt((a.f0 - b.f0) ^ 2 + (a.f1 - b.f1) ^ 2 + (a.f2 - b.f2) ^ 2 + (a.f3 - b.f3) ^ 2) d FROM feat a, feat b),
rk AS (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d, q) rn FROM pr),
kd AS (SELECT p AS Account, d AS kdist FROM rk WHERE rn = 5),
eps AS (SELECT quantile_cont(kdist, 0.9) e FROM kd),
nb AS (SELECT p, count(*) n_within FROM pr, eps WHERE d <= e GROUP BY p),
core AS (SELECT p FROM nb WHERE n_within >= 5),
db AS (SELECT f.Account, CAST(nb.n_within AS BIGINT) AS n_within, f.Account IN (SELECT p FROM core) AS is_core,
              CASE WHEN EXISTS (SELECT 1 FROM pr, eps WHERE pr.p = f.Account AND pr.d <= eps.e
                                AND pr.q IN (SELECT p FROM core)) THEN 0 ELSE 1 END AS dbscan_outlier
       FROM feat f JOIN nb ON nb.p = f.Account),
thr AS (SELECT quantile_cont(-kdist, 0.1) t FROM kd),
acc AS (SELECT s.*, db.dbscan_outlier, CASE WHEN -kd.kdist < thr.t THEN 1 ELSE 0 END AS kdist_outlier
        FROM stats s JOIN db USING (Account) JOIN kd USING (Account), thr),
flags AS (SELECT acc.*, CASE WHEN dbscan_outlier = 1 OR kdist_outlier = 1 THEN 1 ELSE 0 END AS outlier_flag,
                 CASE WHEN dbscan_outlier = 1 AND kdist_outlier = 1 THEN 'both' WHEN dbscan_outlier = 1 THEN 'dbscan_only'
                      WHEN kdist_outlier = 1 THEN 'kdist_only' ELSE 'normal' END AS outlier_type FROM acc)"""


def _forest_sql(n_trees: int = 100, max_samples: int = 256, seed: int = 42, contamination: float = 0.10) -> str:
    """The forest replayed over the table ``feat``: levels by windows, then every account down every tree."""
    levels = math.ceil(math.log2(max_samples))
    each = lambda s: ", ".join(s.replace("#", str(i)) for i in range(4))
    draw = lambda key: f"CAST('0x' || substr(md5(concat_ws(':', {seed}, {key})), 1, 13) AS BIGINT)"
    c = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0::DOUBLE) + {FO.EULER_GAMMA}::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1::DOUBLE ELSE 0::DOUBLE END"
    sql = f"""
fo_gr AS (SELECT Account, {each("CAST(floor(f# * 1e9 + 0.5) AS BIGINT) AS q#")} FROM feat),
fo_ps AS (SELECT least({max_samples}, count(*)) AS psi FROM fo_gr),
fo_tr AS (SELECT gr.*, t.tree, row_number() OVER (PARTITION BY t.tree ORDER BY {draw("t.tree, Account")}, Account) AS rk FROM fo_gr gr, range({n_trees}) t(tree)),
fo_s0 AS (SELECT tree, CAST(1 AS BIGINT) AS node, {each("q#")} FROM fo_tr, fo_ps WHERE rk <= psi),
fo_a0 AS (SELECT Account, tree, CAST(1 AS BIGINT) AS node, 0 AS depth, {each("q#")} FROM fo_tr),"""
    for i in range(levels):
        sql += f"""
fo_w{i} AS (SELECT *, {each("min(q#) OVER w AS lo#")}, {each("max(q#) OVER w AS hi#")} FROM fo_s{i} WINDOW w AS (PARTITION BY tree, node)),
fo_c{i} AS (SELECT *, list_filter([{each("CASE WHEN hi# > lo# THEN # END")}], lambda x: x IS NOT NULL) AS wide FROM fo_w{i}),
fo_k{i} AS (SELECT *, CASE WHEN len(wide) > 0 AND {i} < ceil(log2(greatest(psi, 2))) THEN wide[1 + {draw("tree, node, 'f'")} % len(wide)] END AS k FROM fo_c{i}, fo_ps),
fo_h{i} AS (SELECT *, [{each("lo#")}][k + 1] + CAST(floor({draw("tree, node, 't'")} / CAST({FO.DRAWS} AS DOUBLE) * ([{each("hi#")}][k + 1] - [{each("lo#")}][k + 1])) AS BIGINT) AS cut FROM fo_k{i}),
fo_s{i + 1} AS (SELECT tree, CASE WHEN k IS NULL THEN node ELSE 2 * node + CAST([{each("q#")}][k + 1] > cut AS BIGINT) END AS node, {each("q#")} FROM fo_h{i}),
fo_i{i} AS (SELECT DISTINCT tree, node, k, cut FROM fo_h{i} WHERE k IS NOT NULL),
fo_a{i + 1} AS (SELECT Account, a.tree, CASE WHEN k IS NULL THEN a.node ELSE 2 * a.node + CAST([{each("q#")}][k + 1] > cut AS BIGINT) END AS node,
             depth + CAST(k IS NOT NULL AS INTEGER) AS depth, {each("q#")} FROM fo_a{i} a LEFT JOIN fo_i{i} i ON i.tree = a.tree AND i.node = a.node),"""
    return sql + f"""
fo_lf AS (SELECT tree, node, count(*) AS size FROM fo_s{levels} GROUP BY tree, node),
fs AS (SELECT Account, -pow(2, -(sum(depth * {FO.UNIT} + CAST(floor(({c("size")}) * {FO.UNIT} + 0.5) AS BIGINT)) / (any_value({c("psi")}) * {n_trees} * {FO.UNIT}))) AS if_score
       FROM fo_a{levels} JOIN fo_lf USING (tree, node), fo_ps GROUP BY Account),
fo AS (SELECT Account, if_score, CASE WHEN if_score < (SELECT quantile_cont(if_score, {contamination}) FROM fs) THEN 1 ELSE 0 END AS iforest_outlier FROM fs)"""


_FOREST_SQL = f"{_PAIRS_SQL},{_forest_sql()}"
# the two detectors that SQL can replay, combined: DBSCAN noise or forest
_TYPES_SQL = f"""{_FOREST_SQL},
ty AS (SELECT acc.*, fo.if_score, fo.iforest_outlier, greatest(dbscan_outlier, iforest_outlier) AS forest_flag,
              CASE WHEN dbscan_outlier + iforest_outlier = 2 THEN 'both' WHEN dbscan_outlier = 1 THEN 'dbscan_only'
                   WHEN iforest_outlier = 1 THEN 'iforest_only' ELSE 'normal' END AS forest_type FROM acc JOIN fo USING (Account))"""


@register("d1_k_distance", f"{_PAIRS_SQL} SELECT Account, round(kdist, 6) AS kdist FROM kd")
def q_d1(spark, d):
    return rounded(dbscan_of(spark, d).flags.select("Account", "kdist"))


@register("d2_eps", f"{_PAIRS_SQL} SELECT round(e, 6) AS eps FROM eps")
def q_d2(spark, d):
    kd = dbscan_of(spark, d).flags.select(F.lit(0).alias("all"), "kdist")
    return rounded(group_quantile(kd, "all", "kdist", 0.9, "eps").select("eps"))


@register("d3_dbscan_noise", f"{_PAIRS_SQL} SELECT Account, n_within, is_core, dbscan_outlier FROM db")
def q_d3(spark, d):
    db = dbscan_of(spark, d)
    return db.flags.join(DN.within_counts(db), "Account").select("Account", "n_within", "is_core", "dbscan_outlier")


@register("d3_within_counts", f"{_PAIRS_SQL} SELECT Account, n_within FROM db")
def q_d3n(spark, d):
    return DN.within_counts(dbscan_of(spark, d))


@register("d4_cluster_labels", f"""{_PAIRS_SQL},
ed AS (SELECT pr.p, pr.q FROM pr, eps WHERE pr.d <= eps.e AND pr.p <> pr.q AND pr.p IN (SELECT p FROM core)
       AND pr.q IN (SELECT p FROM core)),
cc(p, lab) AS (SELECT p, p FROM core UNION SELECT ed.q, cc.lab FROM cc JOIN ed ON ed.p = cc.p),
cl AS (SELECT p, min(lab) lab FROM cc GROUP BY p),
bl AS (SELECT pr.p, min(cl.lab) lab FROM pr, eps, cl WHERE pr.d <= eps.e AND pr.q = cl.p
       AND pr.p NOT IN (SELECT p FROM core) GROUP BY pr.p)
SELECT f.Account, coalesce(cl.lab, bl.lab) AS cluster FROM feat f LEFT JOIN cl ON cl.p = f.Account
LEFT JOIN bl ON bl.p = f.Account""")
def q_d4(spark, d):
    return DN.cluster_labels(dbscan_of(spark, d))


@register("d7_threshold_flags", f"{_PAIRS_SQL} SELECT Account, kdist_outlier FROM acc")
def q_d7(spark, d):
    return exact_flags(spark, d).select("Account", "kdist_outlier")


@register("d10_combine", f"{_PAIRS_SQL} SELECT Account, outlier_flag, outlier_type FROM flags")
def q_d10(spark, d):
    return exact_flags(spark, d).select("Account", "outlier_flag", "outlier_type")


@register("d5_hdbscan", None)
def q_d5(spark, d):
    """HDBSCAN (min_cluster_size 5, min_samples 3) over the account features; no SQL form —
    tests compare it with a sequential reference implementation."""
    return hdbscan_of(spark, d)


@register("d6_iforest_scores", f"{_FOREST_SQL} SELECT Account, round(if_score, 6) AS if_score, iforest_outlier FROM fo")
def q_d6(spark, d):
    return rounded(forest_of(spark, d))


@register("d12_detect", None)
def q_d12(spark, d):
    return rounded(detection_of(spark, d).accounts)


@register("d11_metadata", None)
def q_d11(spark, d):
    return rounded(detection_of(spark, d).metadata)


# ---------------------------------------------------------------- O: results (on the exactly reproducible flags)

@register("o1_outlier_counts", f"""{_PAIRS_SQL}
SELECT CAST(sum(outlier_flag) AS BIGINT) AS n_outliers, count(*) AS n_accounts,
       coalesce(sum(outlier_flag) / count(*), 0.0) AS outlier_rate FROM flags""")
def q_o1(spark, d):
    return RE.outlier_counts(exact_flags(spark, d))


@register("o2_outlier_accounts", f"{_PAIRS_SQL} SELECT Account FROM flags WHERE outlier_flag = 1")
def q_o2(spark, d):
    return RE.outlier_accounts(exact_flags(spark, d))


@register("o3_outlier_summary", f"""{_PAIRS_SQL}
SELECT Account, round(w_mean_residual, 6) AS w_mean_residual, outlier_type AS Outlier_Type FROM flags
WHERE outlier_flag = 1""")
def q_o3(spark, d):
    return rounded(RE.outlier_summary(exact_flags(spark, d)).select("Account", "w_mean_residual", "Outlier_Type"))


@register("o4_type_counts", f"{_PAIRS_SQL} SELECT outlier_type, count(*) AS n FROM flags GROUP BY outlier_type")
def q_o4(spark, d):
    return RE.type_counts(exact_flags(spark, d))


@register("o5_top10", f"""{_PAIRS_SQL}
SELECT Account, round(w_mean_residual, 6) AS w_mean_residual, outlier_type FROM flags
ORDER BY abs(w_mean_residual) DESC, Account LIMIT 10""")
def q_o5(spark, d):
    return rounded(RE.top_by_mean(exact_flags(spark, d)).select("Account", "w_mean_residual", "outlier_type"))


@register("o6_first_per_type", f"""{_PAIRS_SQL}
SELECT outlier_type, Account, CAST(rank AS INTEGER) AS rank FROM (
  SELECT outlier_type, Account, row_number() OVER (PARTITION BY outlier_type ORDER BY Account) AS rank FROM flags)
WHERE rank <= 5""")
def q_o6(spark, d):
    return RE.first_per_type(exact_flags(spark, d))


# ---------------------------------------------------------------- V: account series and comparison

# Prices are single IEEE divisions (bit-identical in both engines) and often exact decimal
# ties at the 6th place, so they are compared unrounded.
_V_SERIES = """Account, Date, Unit_Sales AS Units, Auto_Base_Units AS Base_Units,
  CASE WHEN Unit_Sales > 0 THEN Dollar_Sales / Unit_Sales END AS Avg_Price,
  CASE WHEN Auto_Base_Units > 0 THEN Auto_Base_Dollars / Auto_Base_Units END AS Avg_Base_Price"""


@register("v2_v3_account_series", f"SELECT {_V_SERIES} FROM {SV}")
def q_v2(spark, d):
    return SE.account_series(sales_view(spark, d))


@register("v2b_prices_divide_always", f"""
SELECT Account, Date, Unit_Sales AS Units, Auto_Base_Units AS Base_Units,
  CASE WHEN Unit_Sales <> 0 THEN Dollar_Sales / Unit_Sales END AS Avg_Price,
  CASE WHEN Auto_Base_Units <> 0 THEN Auto_Base_Dollars / Auto_Base_Units END AS Avg_Base_Price FROM {SV}""")
def q_v2b(spark, d):
    return SE.account_series(sales_view(spark, d), divide_always=True)


@register("v4_date_range", f"SELECT min(Date) AS min_date, max(Date) AS max_date FROM {SV}")
def q_v4(spark, d):
    return SE.date_range(sales_view(spark, d))


@register("v5_semi_join", f"SELECT * FROM {SVC} WHERE Account IN (SELECT Account FROM {SVC} WHERE {SPEC_SQL})")
def q_v5(spark, d):
    sv = sales_view(spark, d, "customer")
    return SE.rows_of_accounts(sv, FL.apply_filters(sv, SPEC))


@register("v6_anti_join", f"{_PAIRS_SQL} SELECT Account FROM flags WHERE outlier_flag = 0")
def q_v6(spark, d):
    return SE.unflagged_accounts(exact_flags(spark, d))


@register("v7_lookup_join", f"""{_PAIRS_SQL}
SELECT a.Account, coalesce(f.outlier_type, 'normal') AS outlier_type
FROM (SELECT DISTINCT Account FROM {SV}) a LEFT JOIN (SELECT * FROM flags WHERE outlier_flag = 1) f USING (Account)""")
def q_v7(spark, d):
    flagged = exact_flags(spark, d).where(F.col("outlier_flag") == 1)
    return SE.with_badge(sales_view(spark, d), flagged)


@register("v8_first_accounts_series", f"""SELECT {_V_SERIES} FROM {SVC}
WHERE Account IN (SELECT DISTINCT Account FROM {SVC} ORDER BY Account LIMIT 20)""")
def q_v8(spark, d):
    return SE.first_accounts_series(sales_view(spark, d, "customer"), 20)


@register("v9_units_vs_base", f"""
SELECT Account, min(Unit_Sales) AS units_min, max(Unit_Sales) AS units_max, round(avg(Unit_Sales), 6) AS units_mean,
       round(sum(Unit_Sales), 6) AS units_sum, round(min(Auto_Base_Units), 6) AS base_min,
       round(max(Auto_Base_Units), 6) AS base_max, round(avg(Auto_Base_Units), 6) AS base_mean,
       round(sum(Auto_Base_Units), 6) AS base_sum, bool_and(Unit_Sales IS NOT DISTINCT FROM Auto_Base_Units) AS identical,
       round(abs(sum(Unit_Sales) - sum(Auto_Base_Units)) * 100.0 / nullif(sum(Unit_Sales), 0), 6) AS diff_pct
FROM {SV} GROUP BY Account""")
def q_v9(spark, d):
    return rounded(SE.units_vs_base(sales_view(spark, d)))




# ---------------------------------------------------------------- customers as accounts
# 1,500 accounts at sf0.01 with a few rows each: many accounts are missing from some training
# folds, so the fold-baseline branch for unseen levels is exercised against the SQL recipe.

_MFC = _mf_sql(SVC)
_CV5C = _cv_sql([K], _MFC)


@register("k3_cv_residuals_customers", f"""{_CV5C}
SELECT fold, account, round(y, 6) AS actual, round(predicted, 6) AS predicted, round(y - predicted, 6) AS residual,
       round(weight, 6) AS weight, period FROM pred""")
def q_k3c(spark, d):
    m, design = model_frame(spark, d, MODEL, "customer")
    return rounded(CV.run_cv(m, design, K).residuals)


@register("a1_a7_account_stats_customers", f"{_stats_sql(_CV5C)} SELECT {_STATS_COLS} FROM stats")
def q_ac(spark, d):
    return rounded(cv_account_stats(spark, d, MODEL, "customer"))


_PAIRS_C_SQL = f"""{_feat_sql(_CV5C)},
pr AS (SELECT a.Account p, b.Account q,
              sqrt((a.f0 - b.f0) ^ 2 + (a.f1 - b.f1) ^ 2 + (a.f2 - b.f2) ^ 2 + (a.f3 - b.f3) ^ 2) d FROM feat a, feat b),
rk AS (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d, q) rn FROM pr),
kd AS (SELECT p AS Account, d AS kdist FROM rk WHERE rn = 5),
eps AS (SELECT quantile_cont(kdist, 0.9) e FROM kd),
nb AS (SELECT p, count(*) n_within FROM pr, eps WHERE d <= e GROUP BY p),
core AS (SELECT p FROM nb WHERE n_within >= 5)"""


def customers_dbscan_of(spark, d):
    return memo(spark, d, "dbscan_customers", lambda: DN.dbscan(cut_lineage(RS.feature_matrix(cut_lineage(
        cv_account_stats(spark, d, MODEL, "customer")))), 5, 90, 5))


@register("d3_dbscan_noise_customers", f"""{_PAIRS_C_SQL}
SELECT f.Account, round(kd.kdist, 6) AS kdist, CAST(nb.n_within AS BIGINT) AS n_within,
       CASE WHEN EXISTS (SELECT 1 FROM pr, eps WHERE pr.p = f.Account AND pr.d <= eps.e
                         AND pr.q IN (SELECT p FROM core)) THEN 0 ELSE 1 END AS dbscan_outlier
FROM feat f JOIN nb ON nb.p = f.Account JOIN kd ON kd.Account = f.Account""")
def q_d3c(spark, d):
    db = customers_dbscan_of(spark, d)
    return rounded(db.flags.join(DN.within_counts(db), "Account").select("Account", "kdist", "n_within", "dbscan_outlier"))


@register("d3_within_counts_customers", f"{_PAIRS_C_SQL} SELECT p AS Account, CAST(n_within AS BIGINT) AS n_within FROM nb")
def q_d3cn(spark, d):
    return DN.within_counts(customers_dbscan_of(spark, d))


# promo code 1 thins the panel so that some customers occur in one fold only: their held-out
# rows must take the fold's baseline level (30 of 285 accounts at sf0.01).
SPEC_PROMO1 = FL.FilterSpec(lower=1, cot="HOUSEHOLD", acv_threshold=10, auto_promo_code=1, exclude_zero_sales=True)
_PROMO1 = SPEC_SQL.replace("Auto_Promo_Code = 0", "Auto_Promo_Code = 1")
_CVU = _cv_sql([K], _mf_sql(SVC, _PROMO1))


@register("k3_cv_residuals_unseen_levels", f"""{_CVU}
SELECT fold, account, round(y, 6) AS actual, round(predicted, 6) AS predicted, round(y - predicted, 6) AS residual,
       round(weight, 6) AS weight, period FROM pred""")
def q_k3u(spark, d):
    m, design = model_frame(spark, d, MODEL, "customer", SPEC_PROMO1)
    return rounded(CV.run_cv(m, design, K).residuals)


# A predictor that is constant within each account is collinear with the account effect: rows of
# accounts unseen in training take the minimum-norm slope t of the whole centred design,
# t = Σ a·d / (1 + Σ d²) with a, d the account's mean y and its value less the baseline account's.
STORE_ACV = "CAST(10 + CAST(substr(Account, 2) AS INTEGER) % 90 AS DOUBLE)"
MODEL_STORE = ModelSpec("Auto_Base_Units", ("Store_ACV",), ("Account",))
_MFS = _mf_sql(SVC, _PROMO1).replace("ln(greatest(ACV_Weighted_Distribution, 1e-6)) AS x", f"ln({STORE_ACV}) AS x")


@register("k3_cv_residuals_account_constant", f"""WITH RECURSIVE {_folds_sql([K], _MFS)},
d AS (SELECT m.*, fo.fold FROM {_MFS} m JOIN folds fo ON m.period = fo.period),
gm AS (SELECT f.fold, d.a, avg(d.y) my, min(d.x) c FROM d, (SELECT DISTINCT fold FROM folds) f WHERE d.fold <> f.fold GROUP BY f.fold, d.a),
b AS (SELECT fold, arg_min(my, a) my0, arg_min(c, a) c0 FROM gm GROUP BY fold),
t AS (SELECT gm.fold, sum((my - my0) * (c - c0)) / (1 + sum((c - c0) * (c - c0))) t FROM gm JOIN b USING (fold) GROUP BY gm.fold)
SELECT d.fold, d.account, round(d.y, 6) AS actual, round(coalesce(gm.my, b.my0 + t.t * (d.x - b.c0)), 6) AS predicted, d.period
FROM d JOIN b ON b.fold = d.fold JOIN t ON t.fold = d.fold LEFT JOIN gm ON gm.fold = d.fold AND gm.a = d.a""")
def q_k3s(spark, d):
    sv = dated_sales(spark, d, "customer", SPEC_PROMO1).withColumn("Store_ACV", F.expr(STORE_ACV))
    m, design = FE.prepare(sv, MODEL_STORE, "Account", "Time_Period", WEIGHT)
    return rounded(CV.run_cv(m, design, K).residuals.select("fold", "account", "actual", "predicted", "period"))


# ---------------------------------------------------------------- D5 checked: core distances and the tree's weight

_MRD_SQL = f"""{_feat_sql()},
pr AS (SELECT a.Account p, b.Account q,
              sqrt((a.f0 - b.f0) ^ 2 + (a.f1 - b.f1) ^ 2 + (a.f2 - b.f2) ^ 2 + (a.f3 - b.f3) ^ 2) d FROM feat a, feat b),
co AS (SELECT p, d core FROM (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d, q) rn FROM pr) WHERE rn = 3)"""


@register("d5_core_distance", f"{_MRD_SQL} SELECT p AS Account, round(core, 6) AS core FROM co")
def q_d5c(spark, d):
    P, mapping, _ = HD.core_distances(features_of(spark, d), 3)
    return rounded(mapping.join(P.select("pid", "core"), "pid").select("Account", "core"))


@register("d5_mst_weight", f"""{_MRD_SQL},
mr AS MATERIALIZED (SELECT pr.p, pr.q, greatest(a.core, b.core, pr.d) w FROM pr JOIN co a ON a.p = pr.p JOIN co b ON b.p = pr.q WHERE pr.p <> pr.q),
prim AS (SELECT 0 AS n, [min(p)] AS seen, CAST(0 AS DOUBLE) AS w FROM co
         UNION ALL
         SELECT n, list_append(seen, q), w FROM (
             SELECT prim.n + 1 AS n, any_value(prim.seen) AS seen, arg_min(mr.q, mr.w) AS q, min(mr.w) AS w
             FROM prim JOIN mr ON list_contains(prim.seen, mr.p) AND NOT list_contains(prim.seen, mr.q) GROUP BY prim.n))
SELECT round(sum(w), 6) AS weight, count(*) - 1 AS edges FROM prim""")
def q_d5m(spark, d):
    tree, _ = HD.account_tree(features_of(spark, d), 3)
    return rounded(tree.agg(F.sum("w").alias("weight"), F.count("*").alias("edges")))


@register("d8_cluster_validity", None)
def q_d8(spark, d):
    """Per DBSCAN cluster: size, sparseness, separation, validity; held against NumPy in tests."""
    return rounded(VA.cluster_validity(features_of(spark, d), DN.cluster_labels(dbscan_of(spark, d))))


_CHOICE_SQL = f"""{_PAIRS_SQL},
cs AS (SELECT Account, dbscan_outlier AS n_db, kdist_outlier AS n_hd, "count" % 2 = 0 AS available,
              CASE WHEN "count" % 3 = 0 THEN NULL ELSE w_mean_residual END AS s_db,
              CASE WHEN "count" % 5 < 2 THEN NULL ELSE w_std_residual END AS s_hd FROM flags)"""


@register("d9_density_choice", f"""{_CHOICE_SQL}
SELECT Account, CASE WHEN available THEN CASE WHEN s_db IS NOT NULL AND s_hd IS NOT NULL THEN CASE WHEN s_hd >= s_db THEN 'HDBSCAN' ELSE 'DBSCAN' END
                                              WHEN s_hd IS NOT NULL THEN 'HDBSCAN' ELSE 'DBSCAN' END
                     WHEN n_hd > 0 THEN 'HDBSCAN' ELSE 'DBSCAN' END AS method FROM cs""")
def q_d9(spark, d):
    """The rule over one case an account: flags as counts, statistics as scores, some undefined."""
    c = F.col("count")
    return exact_flags(spark, d).select("Account", DC.choice(
        F.col("dbscan_outlier"), F.col("kdist_outlier"), c % 2 == 0, F.when(c % 3 != 0, F.col("w_mean_residual")),
        F.when(c % 5 >= 2, F.col("w_std_residual"))).alias("method"))


# ---------------------------------------------------------------- the detector's own flags (rows only; tests hold them against one another)

@register("d7_forest_flags", f"{_FOREST_SQL} SELECT Account, iforest_outlier FROM fo")
def q_d7f(spark, d):
    return detection_of(spark, d).accounts.select("Account", "iforest_outlier")


@register("d10_forest_types", f"{_TYPES_SQL} SELECT Account, round(if_score, 6) AS if_score, forest_flag AS outlier_flag, forest_type AS outlier_type FROM ty")
def q_d10f(spark, d):
    return rounded(forest_types(spark, d).select("Account", "if_score", "outlier_flag", "outlier_type"))


@register("o1_forest_counts", f"""{_TYPES_SQL}
SELECT CAST(sum(forest_flag) AS BIGINT) AS n_outliers, count(*) AS n_accounts, coalesce(sum(forest_flag) / count(*), 0.0) AS outlier_rate FROM ty""")
def q_o1f(spark, d):
    return RE.outlier_counts(forest_types(spark, d))


@register("o4_forest_type_counts", f"{_TYPES_SQL} SELECT forest_type AS outlier_type, count(*) AS n FROM ty GROUP BY forest_type")
def q_o4f(spark, d):
    return RE.type_counts(forest_types(spark, d))


@register("d10_detect_types", None)
def q_d10d(spark, d):
    return detection_of(spark, d).accounts.select("Account", "outlier_flag", "outlier_type")


@register("o1_detect_counts", None)
def q_o1d(spark, d):
    return RE.outlier_counts(detection_of(spark, d).accounts)


@register("o3_detect_summary", None)
def q_o3d(spark, d):
    return rounded(RE.outlier_summary(detection_of(spark, d).accounts).select("Account", "w_mean_residual", "Outlier_Type"))


# ---------------------------------------------------------------- S6, V3: export and order

@register("s6_export_round_trip", "SELECT * FROM customer")
def q_s6(spark, d):
    path = scratch_path(spark, "export.parquet")
    LD.export_table(table(spark, d, "customer"), path, "parquet")
    return LD.load_data(spark, path)


@register("s6_export_csv", "SELECT page_id, nullif(url, '') AS url, nullif(html, '') AS html FROM pages")
def q_s6c(spark, d):
    """Web pages through CSV and back: quotes, separators and line breaks inside fields."""
    pages, path = table(spark, d, "pages").select("page_id", "url", "html"), scratch_path(spark, "pages.csv")
    LD.export_table(pages, path, "csv")
    return LD.load_csv(spark, path, pages.schema).rows


@register("s1_load_csv", "SELECT * FROM lineitem")
def q_s1c(spark, d):
    lines, path = table(spark, d, "lineitem"), scratch_path(spark, "lineitem.csv")
    LD.export_table(lines, path, "csv")
    return LD.load_csv(spark, path, lines.schema, multi_line=False).rows


@register("s1_load_csv_broken", """
SELECT CAST(o_orderkey AS BIGINT) AS orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 5 > 1 THEN o_custkey END AS BIGINT) AS custkey,
       CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey, ',', o_orderstatus, ',n/a') WHEN 1 THEN concat(o_orderkey, ',', o_orderstatus) END AS record
FROM orders""")
def q_s1b(spark, d):
    """Every order as a CSV line; a fifth of them with a word for a number, a fifth one field short."""
    path, key, status = scratch_path(spark, "orders.csv"), F.col("o_orderkey"), F.col("o_orderstatus")
    last = F.when(key % 5 == 0, F.lit("n/a")).when(key % 5 != 1, F.col("o_custkey").cast("string"))
    table(spark, d, "orders").select(F.concat_ws(",", key, status, last).alias("value")).write.text(path)
    got = LD.load_csv(spark, path, T.StructType().add("orderkey", "long").add("status", "string").add("custkey", "long"), header=False)
    return got.rows.withColumn("record", F.lit(None).cast("string")).unionByName(got.rejected.select(
        F.split("record", ",")[0].cast("long").alias("orderkey"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("long").alias("custkey"), "record"))


@register("v3_ordered_series", f"""
SELECT Account, Date, Units, Base_Units, CAST(row_number() OVER (PARTITION BY Account ORDER BY Date, Units NULLS FIRST,
       Base_Units NULLS FIRST, Avg_Price NULLS FIRST, Avg_Base_Price NULLS FIRST) AS INTEGER) AS position
FROM (SELECT {_V_SERIES} FROM {SV})""")
def q_v3(spark, d):
    return SE.with_position(SE.account_series(sales_view(spark, d))).select("Account", "Date", "Units", "Base_Units", "position")


# ---------------------------------------------------------------- the saved run: filtered chain

_CV5F = _cv_sql([K], _mf_sql(SV, SPEC_SQL))


@register("k3_cv_residuals_filtered", f"""{_CV5F}
SELECT fold, account, round(y, 6) AS actual, round(predicted, 6) AS predicted, round(y - predicted, 6) AS residual,
       round(weight, 6) AS weight, period FROM pred""")
def q_k3f(spark, d):
    m, design = model_frame(spark, d, filters=SPEC)
    return rounded(CV.run_cv(m, design, K).residuals)


# ---------------------------------------------------------------- flagship

@register("flagship_worst_explained", f"""{_stats_sql(_CV5F)}
SELECT Account, round(w_mean_residual, 6) AS w_mean_residual, round(w_std_residual, 6) AS w_std_residual,
       "count", round(z_mean_residual, 6) AS z_mean_residual FROM stats
ORDER BY abs(w_mean_residual) DESC, Account LIMIT 10""")
def q_flagship(spark, d):
    """Which suppliers does the model explain worst?  Sales view → periods → filters → log
    model with the account effect, cross-validated over whole periods → weighted residual
    statistics per account → the ten largest |weighted mean residual|."""
    st = cv_account_stats(spark, d, filters=SPEC)
    return rounded(RE.top_by_mean(st).select("Account", "w_mean_residual", "w_std_residual", "count",
                                             "z_mean_residual"))


FLAGSHIP = "flagship_worst_explained"
