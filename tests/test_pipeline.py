from pyspark.sql import functions as F

from acctlens import pipeline as PL
from acctlens.operators.filters import FilterSpec
from acctlens.session import scratch_scope
from acctlens.settings import CVSpec, DetectSpec, ModelSpec
from acctlens.sources.sales import sales_view

SF = "/root/testdata/sf0.01"


def test_the_whole_chain(spark):
    sales = sales_view(spark, SF)
    with scratch_scope(spark):
        prepared = PL.prepare(sales, FilterSpec(lower=1, cot="HOUSEHOLD", acv_threshold=10, auto_promo_code=0, exclude_zero_sales=True))
        model, cv = ModelSpec("Auto_Base_Units", ("ACV_Weighted_Distribution",), ("Account",)), CVSpec(4, "Time_Period", "Account", "Auto_Base_Units")
        a = PL.analyse(prepared.kept, model, cv, DetectSpec(use_validity=True))
        n = prepared.kept.count()
        assert a.cv.residuals.count() == n and a.folds.count() == 4 and prepared.steps.count() == 1
        acc = a.detection.accounts.toPandas()
        meta = a.detection.metadata.first()
        dens = acc.hdbscan_outlier if a.detection.method == "HDBSCAN" else acc.dbscan_outlier
        assert ((acc.outlier_flag == 1) == ((dens == 1) | (acc.iforest_outlier == 1))).all()
        want = {(1, 1): "both", (1, 0): f"{a.detection.method.lower()}_only", (0, 1): "iforest_only", (0, 0): "normal"}
        assert [want[int(d), int(f)] for d, f in zip(dens, acc.iforest_outlier)] == list(acc.outlier_type)
        assert meta.combined_outliers == acc.outlier_flag.sum() == a.summary.count()
        assert meta.n_accounts == len(acc) and meta.dbscan_outliers == acc.dbscan_outlier.sum() and meta.hdbscan_clusters is not None
        by_quarter = PL.best_k(prepared.kept.withColumn("Quarter", F.date_trunc("quarter", "Date")), model, CVSpec(2, "Quarter", "Account"), range(2, 4))
        assert by_quarter.count() == 2
        series = PL.account_series(sales, prepared.kept).collect()
        assert [(r.Account, r.Date) for r in series] == sorted((r.Account, r.Date) for r in series)
        assert {r.Account for r in series} == {r.Account for r in prepared.kept.select("Account").distinct().collect()}
