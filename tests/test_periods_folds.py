import datetime as dt

import pytest

from acctlens.operators import crossval as CV
from acctlens.operators import periods as PE


def test_elapsed_days_not_calendar_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), ), (dt.datetime(2024, 4, 1, 22), )], "Date timestamp_ntz")
    got = [r.Time_Period for r in PE.create_time_periods(df, "Date", 13).orderBy("Date").collect()]
    assert got == [1, 1]                                  # 90 elapsed days, 91 calendar days


def test_equal_periods_drop_bad_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("not a date",), ("2024-04-02",)], "Date string")
    out = PE.create_equal_periods(df, "Date", 13).orderBy("Date").collect()
    assert [r.Time_Period for r in out] == [1, 2]
    with pytest.raises(PE.PeriodError):
        PE.create_equal_periods(spark.createDataFrame([("x",)], "Date string"), "Date", 13)


def test_coverage_invalid_and_calendar_cap(spark):
    weekly = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * i),) for i in range(13)],
                                   "Date timestamp_ntz")  # 84 days = 12 weeks
    ok, msg, table = PE.validate_period_coverage(weekly, "Date", 13)
    assert not ok and table is None and "0 periods" in msg
    long = spark.createDataFrame([(dt.datetime(2000, 1, 1),), (dt.datetime(2000, 1, 1) + dt.timedelta(days=150 * 28),)],
                                 "Date timestamp_ntz")
    rows = PE.calendar_boundaries(long, "Date", 4).orderBy("Period").collect()
    assert len(rows) == 151 and rows[-1].End_Date == "2011-07-02"       # every period, however many
    assert PE.calendar_summary(PE.calendar_boundaries(long, "Date", 4), 4).first().total_periods == 151


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo", "UTC"])
def test_zoned_timestamps_count_by_the_sessions_wall_clock(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("SELECT explode(sequence(timestamp'2024-03-01 00:00:00', timestamp'2024-03-15 00:00:00', interval 1 day)) AS Date")
        want = [i // 7 + 1 for i in range(15)]                           # a change to summer time lies between
        for f in (PE.create_time_periods, PE.create_equal_periods):
            assert [r.Time_Period for r in f(df, "Date", 1).orderBy("Date").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_greedy_fold_assignment(spark):
    counts = spark.createDataFrame([(1, 20), (2, 18), (3, 20), (4, 5), (5, 9)], "period int, c long")
    got = {r.period: r.fold for r in CV.fold_assignment(counts, [3]).collect()}
    assert got == {3: 1, 1: 2, 2: 3, 5: 3, 4: 1}


def test_anchor_independent_of_session_time_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23),), (dt.datetime(2024, 4, 1, 22),),
                                (dt.datetime(2024, 4, 1, 23),)], "Date timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = [r.Time_Period for r in PE.create_time_periods(df, "Date", 13).orderBy("Date").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [1, 1, 2]
