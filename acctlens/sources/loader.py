"""Sources, profiling and sinks.

S1 reads CSV or Parquet by extension.  Profiling is one aggregate pass over the table (never
one job per column) followed by an unpivot of the one-row result into long form.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctlens.functions.columns import Names, qcol
from acctlens.session import cut_lineage


# Quotes are doubled inside quotes, line breaks may stand there, blanks stay, times keep microseconds.
CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
               "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class DataLoadError(ValueError):
    """The input cannot be loaded as a non-empty table."""


def load_data(spark: SparkSession, path: str, schema: T.StructType | None = None,
              check_empty: bool = True, nan_as_null: bool = False, required: tuple = ()) -> DataFrame:
    """Read a table by file extension (case-insensitive).

    Spark resolves the path, so globs, the default filesystem and any store it can read work.
    CSV is read with a header (an explicit schema is preferred; otherwise it is inferred, at the
    cost of reading the file twice; ``load_csv`` keeps broken records apart); Parquet keeps its own schema.  ``nan_as_null`` turns floating
    NaN into NULL so that it behaves as missing in every later predicate (in Spark ``NaN >= x`` is
    true); the operators here treat NaN as missing by themselves, so it is off by default and
    filters reach the scan.
    """
    ext = os.path.splitext(path.rstrip("/*"))[1].lower()
    try:
        if ext == ".csv":
            reader = spark.read.options(header=True, multiLine=True, **CSV_OPTIONS)
            reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
            df = reader.csv(path)
        elif ext in (".parquet", ".pq", ""):             # a folder without an ending holds Parquet
            df = spark.read.parquet(path)
        else:
            raise DataLoadError(f"Cannot read files of type {ext}: {path}")
    except AnalysisException as e:
        raise DataLoadError(f"Cannot read {path}: {e.getCondition() or e}") from e
    if len(df.columns) == 0:
        raise DataLoadError(f"No columns in {path}")
    Names(df).require(required)
    if nan_as_null:
        df = nan_to_null(df)
    if check_empty and df.isEmpty():
        raise DataLoadError(f"No rows in {path}")
    return df


@dataclass
class CsvLoad:
    rows: DataFrame         # the rows that fit the schema, its columns
    rejected: DataFrame     # record: the text of each row that does not


def load_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = True) -> CsvLoad:
    """S1 for CSV with a declared schema: one read, no inference.

    A record with a value of another type, or with too few or too many fields, is kept apart with its text and
    reaches no operator.  The header must name the schema's columns in order.  Quoted fields may hold
    line breaks, separators and doubled quotes; then a file is one task (``multi_line=False`` splits
    large files where no field holds a break).  An empty field is NULL, quoted or not.  The parsed
    records are written once, since Spark may otherwise prune the columns that show a record broken."""
    bad = "__record"
    while bad in schema.fieldNames():
        bad += "_"
    options = CSV_OPTIONS | {"header": header, "enforceSchema": not header, "multiLine": multi_line,
                             "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    nullable = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    held = cut_lineage(spark.read.options(**options).schema(T.StructType([*nullable, T.StructField(bad, T.StringType())])).csv(path))
    return CsvLoad(held.where(F.col(bad).isNull()).drop(bad), held.where(F.col(bad).isNotNull()).select(F.col(bad).alias("record")))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN → NULL (pandas treats NaN as missing; Spark treats it as a value)."""
    exprs = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


def column_info(df: DataFrame, exact_unique: bool = True, rsd: float = 0.01) -> DataFrame:
    """S3: per column dtype, null_count, null_pct (rounded 2) and unique_count (nulls excluded).

    One pass: a single global aggregate with two expressions per column, then an unpivot.
    Exact distinct counts over many columns make Spark expand every row once per column;
    ``exact_unique=False`` uses mergeable HyperLogLog++ sketches instead (relative error ``rsd``)
    for wide or very large tables."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        aggs.append(F.count_if(c.isNull()).alias(f"__nul{i}"))
        aggs.append((F.count_distinct(c) if exact_unique else F.approx_count_distinct(c, rsd)).alias(f"__unq{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.col(f"__nul{i}").alias("null_count"), F.col(f"__unq{i}").alias("unique_count"))
            for i, f in enumerate(df.schema.fields)]
    return (one.select("__n", F.inline(F.array(*rows)))
            .select(F.col("ordinal").cast("int"), "column", "dtype",
                    F.col("null_count").cast("long"),
                    F.round(F.try_divide(F.col("null_count") * 100.0, F.col("__n")), 2).alias("null_pct"),
                    F.col("unique_count").cast("long")))


def dataset_overview(df: DataFrame, account: str = "Account", date: str = "Date") -> DataFrame:
    """Rows, columns, distinct accounts, date span in whole days, non-null cells, null %."""
    n_cols = len(df.columns)
    non_null = sum((F.count(qcol(c)) for c in df.columns), F.lit(0))
    d = qcol(date)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_cols).cast("int").alias("n_columns"),
        F.count_distinct(qcol(account)).alias("n_accounts"),
        F.timestamp_diff("DAY", F.min(d), F.max(d)).alias("date_span_days"),
        non_null.cast("long").alias("non_null_cells"),
    ).select("*", F.round(F.try_divide((F.col("n_rows") * n_cols - F.col("non_null_cells")) * 100.0,
                                        F.col("n_rows") * n_cols), 2).alias("null_pct"))


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in a declared key order (file order does not exist in Spark)."""
    return df.orderBy(*[qcol(c) for c in order_by]).limit(n)


def export_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a result table (CSV with header, or Parquet) — a distributed write.  ``load_csv`` reads
    the CSV back; only NULL and the empty string are one there."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(header=True, **CSV_OPTIONS).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise DataLoadError(f"Unsupported output format: {fmt}")


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    """Numeric vs categorical columns from the schema (no job)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    categorical = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return {"numeric": numeric, "categorical": categorical}
