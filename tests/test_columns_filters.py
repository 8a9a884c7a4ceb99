import pytest
from pyspark.sql import functions as F

from acctlens.functions.columns import ColumnNotFound, Names, find_column, metric_columns
from acctlens.operators.filters import FilterError, FilterSpec, apply_filters, filter_summary


def test_normalize_names():
    for n in ["Unit Sales", "Unit_Sales", "Unit.Sales", "UNIT SALES"]:
        assert Names.plain(n) == "unitsales"
    assert Names.plain("ACV > 10") == "acv10"


def test_find_column_first_alias_and_last_collision_wins():
    cols = ["Unit Sales", "unit_sales", "COT"]
    assert find_column(cols, "Unit_Sales") == "unit_sales"
    assert find_column(cols, "Channel of Trade", "COT") == "COT"
    with pytest.raises(ColumnNotFound, match="none of Lower"):
        find_column(cols, "Lower")


def test_metric_columns():
    cols = ["Account", "Any_Merch_Unit_Sales", "unit sales x", "Base Units", "Dollar_Sales"]
    m = metric_columns(cols)
    assert m["units"] == "unit sales x" and m["base_units"] == "Base Units" and m["dollars"] == "Dollar_Sales"
    assert m["base_dollars"] is None


@pytest.fixture()
def a3(spark):
    rows = [("A1", 1, "Food", 10, 0, 100), ("A2", 1, "Food", 20, 0, 200), ("A3", 0, "Food", 30, 0, 300),
            ("A4", 1, "Beverage", 40, 1, 0), ("A5", 1, "Food", 50, 0, 500)]
    return spark.createDataFrame(rows, "Account string, Lower int, COT string, `ACV Weighted Distribution` int, "
                                       "`Auto.Promo.Code` int, `Unit Sales` int")


def test_filters_reference_cases(a3):
    assert apply_filters(a3, FilterSpec(lower=1)).count() == 4
    got = {r.Account for r in apply_filters(a3, FilterSpec(lower=1, cot="Food", auto_promo_code=0)).collect()}
    assert got == {"A1", "A2", "A5"}
    spec = FilterSpec(lower=1, cot="Food", acv_threshold=1, auto_promo_code=0, exclude_zero_sales=True)
    assert {r.Account for r in apply_filters(a3, spec).collect()} == {"A1", "A2", "A5"}


def test_filter_errors(a3):
    with pytest.raises(FilterError, match="No data remains"):
        apply_filters(a3, FilterSpec(lower=999), check_empty=True)
    with pytest.raises(FilterError, match="none of COT"):
        apply_filters(a3.drop("COT"), FilterSpec(cot="Food"))


def test_filter_summary(spark, a3):
    ten = a3.unionByName(a3)
    r = filter_summary(ten, FilterSpec(lower=1, cot="Food", auto_promo_code=0)).first()
    assert (r.rows_original, r.rows_filtered, r.rows_removed) == (10, 6, 4)
    empty = a3.where(F.lit(False))
    assert filter_summary(empty, FilterSpec(lower=1)).first().percent_removed == 0.0


def test_missing_values_semantics(spark):
    df = spark.createDataFrame([("a", None, 20.0), ("b", 0.0, 20.0), ("c", 5.0, None), ("d", float("nan"), 30.0)],
                               "Account string, Unit_Sales double, ACV double")
    from acctlens.sources.loader import nan_to_null
    df = nan_to_null(df)
    kept = {r.Account for r in apply_filters(df, FilterSpec(exclude_zero_sales=True)).collect()}
    assert kept == {"a", "c", "d"}                       # missing sales survive the zero exclusion
    kept = {r.Account for r in apply_filters(df, FilterSpec(acv_threshold=10)).collect()}
    assert kept == {"a", "b", "d"}                       # missing ACV fails the threshold


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    rows = [("A1", 1, "Food", 20.0, 0, 5.0), ("A2", 0, "Food", 30.0, 0, 0.0)]
    path = str(tmp_path / "flat")
    spark.createDataFrame(rows, "Account string, Lower int, COT string, ACV double, Auto_Promo_Code int, "
                                "Unit_Sales double").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = spark.read.parquet(path)
    spec = FilterSpec(lower=1, cot="Food", acv_threshold=10, auto_promo_code=0)
    plan = apply_filters(df, spec)._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(Lower,1)", "EqualTo(COT,Food)", "GreaterThanOrEqual(ACV,10.0)", "EqualTo(Auto_Promo_Code,0)"):
        assert pushed in plan, plan
    assert [r.Account for r in apply_filters(df, spec).collect()] == ["A1"]


def test_export_and_sketch_profile(spark, tmp_path):
    from acctlens.sources.loader import column_info, export_table, load_data
    df = spark.createDataFrame([("A1", 1), ("A2", 2), (None, 2)], "Account string, Sales long")
    out = str(tmp_path / "out.csv")
    export_table(df, out, "csv")
    back = load_data(spark, out)
    assert back.count() == 3 and sorted(back.columns) == ["Account", "Sales"]
    exact = {r.column: r for r in column_info(df).collect()}
    assert exact["Account"].null_count == 1 and exact["Account"].unique_count == 2
    assert exact["Account"].null_pct == pytest.approx(33.33)
    sketch = {r.column: r.unique_count for r in column_info(df, exact_unique=False).collect()}
    assert sketch == {"Account": 2, "Sales": 2}


def test_k_bounds():
    from acctlens.operators.crossval import k_bounds
    assert k_bounds(28) == (10, 5) and k_bounds(3, best_k=7) == (3, 3) and k_bounds(6, saved=4) == (6, 4)
