import datetime

import pytest
from pyspark.sql import types as T

from acctlens.session import scratch_scope
from acctlens.sources.loader import export_table, load_csv, load_data

SCHEMA = T.StructType().add("Account", "string").add("n", "integer").add("x", "double").add("at", "timestamp_ntz")
AT = datetime.datetime(2024, 2, 29, 23, 59, 59, 123456)
ROWS = [('say "hi", you', 1, 0.1, AT), ("two\nlines\r\nand \\ back\\", 2, -1e-300, AT), ("  blanks ", 3, None, None), (None, None, 1e22, AT),
        ("a" * 200_000, 4, 2.0, AT), ("#no comment", 5, 3.0, None), ('"', 6, 1 / 3, AT), ("same", 7, 1.0, AT), ("same", 7, 1.0, AT)]


def key(r):
    return tuple((v is None, v) if v is not None else (True, "") for v in r)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    df = spark.createDataFrame(ROWS, SCHEMA)
    with scratch_scope(spark):
        export_table(df.repartition(3), path, "csv")
        got = load_csv(spark, path, SCHEMA)
        assert sorted(map(key, map(tuple, got.rows.collect()))) == sorted(map(key, ROWS))
        assert got.rows.schema == SCHEMA and got.rejected.count() == 0
        read = load_data(spark, path).collect()                                     # inferred types
        assert sorted(str(r["Account"]) for r in read) == sorted(str(r[0]) for r in ROWS)


def test_broken_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Account,n,x,at\nA,1,2.5,2024-01-01T00:00:00.000000\nB,one,2.5,\nC,3\n"D\nE",4,"",""\nF,5,1,,surplus\n')
    got = load_csv(spark, str(tmp_path / "in.csv"), SCHEMA)
    assert sorted(tuple(r)[:3] for r in got.rows.collect()) == [("A", 1, 2.5), ("D\nE", 4, None)]
    assert sorted(r["record"] for r in got.rejected.collect()) == ["B,one,2.5,", "C,3", "F,5,1,,surplus"]
    assert got.rows.select("n").where("n > 0").count() == 2                         # pruned reads agree


def test_header_must_fit(spark, tmp_path):
    (tmp_path / "in.csv").write_text("n,Account,x,at\n1,A,2.5,\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_csv(spark, str(tmp_path / "in.csv"), SCHEMA)


def test_empty_file_and_clashing_name(spark, tmp_path):
    schema = T.StructType().add("__record", "string").add("n", "integer")
    (tmp_path / "in.csv").write_text("__record,n\n")
    assert load_csv(spark, str(tmp_path / "in.csv"), schema).rows.collect() == []
    (tmp_path / "one.csv").write_text("__record,n\nx,1\ny,z\n")
    got = load_csv(spark, str(tmp_path / "one.csv"), schema)
    assert [tuple(r) for r in got.rows.collect()] == [("x", 1)] and [r[0] for r in got.rejected.collect()] == ["y,z"]
