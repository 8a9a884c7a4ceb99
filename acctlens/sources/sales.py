"""The driver's TPC-H-like tables seen as a sales panel.

``sales_view`` joins lineitem ⋈ orders ⋈ customer into the column set the pipeline knows by
name (Account, Date, Lower, COT, ACV_Weighted_Distribution, Auto_Promo_Code, Unit_Sales,
Dollar_Sales, Auto_Base_Units, Auto_Base_Dollars, Price_Bucket_Quarter).  Both joins are
foreign-key joins on the fact table; Catalyst prunes every column not used downstream and
pushes row filters into the lineitem scan.  ``SALES_VIEW_SQL`` is the same view for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_view(spark: SparkSession, sf_dir: str, account_key: str = "supplier") -> DataFrame:
    """One row per lineitem.  ``account_key='customer'`` makes the customer the account
    (1,500 accounts at sf0.01 instead of 100 suppliers)."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # orders meet the customers first, so the lineitems are shuffled once
    j = li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), li.l_orderkey == F.col("o_orderkey"))
    key = F.col("l_suppkey") if account_key == "supplier" else F.col("o_custkey")
    prefix = "S" if account_key == "supplier" else "C"
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    return j.select(
        F.concat(F.lit(prefix), F.lpad(key.cast("string"), 6, "0")).alias("Account"),
        F.col("l_shipdate").alias("Date"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("Lower"),
        F.col("c_mktsegment").alias("COT"),
        (F.col("l_quantity") * 2.0).alias("ACV_Weighted_Distribution"),
        F.when(F.col("l_discount") >= 0.08, 1).otherwise(0).alias("Auto_Promo_Code"),
        F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("Unit_Sales"),
        F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("Dollar_Sales"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("Auto_Base_Units"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("Auto_Base_Dollars"),
        F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string"), F.lit("_"),
                 F.when(unit_price < 1500, "low").when(unit_price < 4000, "mid").otherwise("high"))
        .alias("Price_Bucket_Quarter"),
    )


def sales_view_sql(account_key: str = "supplier") -> str:
    """The same view as a DuckDB/ANSI subquery."""
    key = "l.l_suppkey" if account_key == "supplier" else "o.o_custkey"
    prefix = "S" if account_key == "supplier" else "C"
    return f"""(SELECT concat('{prefix}', lpad(CAST({key} AS VARCHAR), 6, '0')) AS Account,
       l.l_shipdate AS Date,
       CAST(CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS Lower,
       c.c_mktsegment AS COT,
       l.l_quantity * 2.0 AS ACV_Weighted_Distribution,
       CAST(CASE WHEN l.l_discount >= 0.08 THEN 1 ELSE 0 END AS INTEGER) AS Auto_Promo_Code,
       CASE WHEN l.l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE l.l_quantity END AS Unit_Sales,
       CASE WHEN l.l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE l.l_extendedprice END AS Dollar_Sales,
       l.l_quantity * (1 - l.l_discount) AS Auto_Base_Units,
       l.l_extendedprice * (1 - l.l_discount) AS Auto_Base_Dollars,
       concat('Q', CAST(quarter(l.l_shipdate) AS VARCHAR), '_',
              CASE WHEN l.l_extendedprice / l.l_quantity < 1500 THEN 'low'
                   WHEN l.l_extendedprice / l.l_quantity < 4000 THEN 'mid' ELSE 'high' END) AS Price_Bucket_Quarter
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)"""
