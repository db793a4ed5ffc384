"""Hand-made edge rows (cleaning, pairing, bins, flags, weighted median, buckets)."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from knockon.functions import scalar as X
from knockon.operators import clean as C
from knockon.operators import decay as D
from knockon.operators import pairs as P

RAW_SCHEMA = ("rid long, TAIL_NUM string, FL_DATE string, OP_UNIQUE_CARRIER string, ORIGIN string, "
              "DEST string, CRS_DEP_TIME string, CRS_ARR_TIME string, DEP_DELAY string, "
              "ARR_DELAY string, DISTANCE string, CANCELLED string, DIVERTED string")


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_hhmm_parse(spark):
    df = spark.createDataFrame(
        [(1, "2024-02-28", 2400.0), (2, "2024-02-28", 1275.0), (3, "2024-02-28", -5.0),
         (4, "2024-02-28", 2500.0), (5, "2024-02-28", None), (6, None, 1230.0), (7, "2024-02-29", 5.0)],
        "id int, d string, t double").withColumn("d", F.to_date("d"))
    out = {r.id: (r.ts, r.h) for r in df.select(
        "id", X.hhmm_timestamp("d", "t").alias("ts"), X.hhmm_hour("d", "t").alias("h")).collect()}
    assert out[1] == (dt.datetime(2024, 2, 29, 0, 0), 0)
    for i in (2, 3, 4, 5, 6):
        assert out[i] == (None, None)
    assert out[7] == (dt.datetime(2024, 2, 29, 0, 5), 0)


def test_clean_filters_and_overnight(spark):
    rows = [
        (1, " N1 ", "2024-01-05", "AA", "S1", "S2", "2350", "0110", "5", "7", "100", "0", "0"),
        (2, None, "2024-01-05", "AA", "S1", "S2", "1000", "1100", "5", "7", "100", "0", "0"),
        (3, "   ", "2024-01-05", "AA", "S1", "S2", "1000", "1100", "5", "7", "100", "0", "0"),
        (4, "N2", "2024-01-05", "AA", "S1", "S2", "1000", "1100", "5", "7", "100", None, "0"),
        (5, "N2", "2024-01-05", "AA", "S1", "S2", "1000", "1100", "5", "7", "100", "1", "0"),
        (6, "N2", "bad-date", "AA", "S1", "S2", "1000", "1100", "5", "7", "100", "0", "0"),
        (7, "N2", "2024-01-05", "AA", "S1", "S2", "1000", "1100", "oops", "7", "100", "0", "1"),
    ]
    out = {r.rid: r for r in C.clean_flights(raw(spark, rows), keep=["rid"]).collect()}
    assert sorted(out) == [1, 4]                      # null/blank tail, cancelled, bad date, diverted
    assert out[1].TAIL_NUM == "N1"                    # trimmed
    assert out[1].sched_arr_timestamp == dt.datetime(2024, 1, 6, 1, 10)   # overnight fix
    assert out[1].day_of_week == 5 and out[1].month == 1                  # Friday = 5
    assert out[4].CANCELLED is None                   # null cancelled is kept


def _pair_rows(spark, gaps):
    """One tail: arrival at 10:00, then departures ``gap`` minutes later at the same airport."""
    rows = []
    for i, gap in enumerate(gaps):
        base = dt.datetime(2024, 3, 1 + i, 10, 0)
        dep = base + dt.timedelta(minutes=gap)
        rows.append((10 * i, "N9", base.strftime("%Y-%m-%d"), "AA", "S0", "S1", "0800", "1000",
                     "0", "0", "100", "0", "0"))
        rows.append((10 * i + 1, "N9", dep.strftime("%Y-%m-%d"), "AA", "S1", "S0",
                     dep.strftime("%H%M"), (dep + dt.timedelta(minutes=30)).strftime("%H%M"),
                     "16", "15", "100", "0", "0"))
    return raw(spark, rows)


def test_turnaround_bounds_and_bins(spark):
    clean = C.clean_flights(_pair_rows(spark, [19, 20, 600, 601, 44.5 and 44, 45, 90, 180]), keep=["rid"])
    pairs = {r.rid: r for r in P.flight_pairs(clean, tiebreak=["rid"], keep=["rid"]).collect()}
    got = {rid // 10: r.scheduled_turnaround_minutes for rid, r in pairs.items() if rid % 10 == 1}
    assert 0 not in got and 3 not in got              # 19 and 601 dropped
    assert got[1] == 20.0 and got[2] == 600.0
    bins = spark.createDataFrame([(v,) for v in [44.5, 45.0, 90.0, 180.0, 600.0, 19.9, 600.5]], "m double")
    labels = [r[0] for r in bins.select(X.turnaround_bin("m")).collect()]
    assert labels == ["20-44", "45-89", "90-179", "180-600", "180-600", None, None]


def test_flags_and_prev_bins(spark):
    df = spark.createDataFrame([(15.0,), (16.0,), (None,), (-120.0,), (-60.0,), (0.0,), (480.0,), (481.0,)],
                               "d double")
    flags = [r[0] for r in df.select(X.flag_over("d")).collect()]
    assert flags[:3] == [0, 1, 0]
    bins = [r[0] for r in df.select(X.prev_delay_bin("d")).collect()][3:]
    assert bins == ["-120 to -60", "-120 to -60", "-5 to 0", "240 to 480", None]


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 1), (1, 3.0, 2)], "g int, v double, w long")
    assert D.weighted_median(df, ["g"], "v", "w").collect()[0][1] == 2.0


def test_tail_bucket_matches_zlib(spark):
    tails = [" N123 ", "N9", "ÅBC", None]
    df = spark.createDataFrame([(t,) for t in tails], "t string")
    got = [r[0] for r in df.select(X.tail_bucket("t", 100)).collect()]
    want = [0 if t is None else zlib.crc32(t.strip().encode("utf-8")) % 100 for t in tails]
    assert got == want


def test_missing_required_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(C.MissingColumnsError):
        C.clean_flights(df)


def test_alias_resolution(spark):
    df = spark.createDataFrame([("N1", "2024-01-02", "AA", "X", "Y", "900", "1000", "1", "2", "3", "0", "0", "4")],
                               "Tail_Number string, FlightDate string, Reporting_Airline string, Origin string, "
                               "Dest string, CRSDepTime string, CRSArrTime string, DepDelay string, "
                               "ArrDelay string, Distance string, Cancelled string, Diverted string, Month string")
    r = C.clean_flights(df).collect()[0]
    assert (r.TAIL_NUM, r.OP_UNIQUE_CARRIER, r.month, r.route) == ("N1", "AA", 4, "X-Y")


def test_trimmed_wide_layout_cannot_feed_cleaning(spark):
    from knockon import schema as S
    from knockon.sources import files as SRC
    wide = spark.createDataFrame([tuple("1" for _ in S.TRIM_COLUMNS)], ", ".join(f"`{c}` string" for c in S.TRIM_COLUMNS))
    trimmed = SRC.trim_columns(wide)
    assert trimmed.columns == S.TRIM_COLUMNS
    with pytest.raises(C.MissingColumnsError):
        C.clean_flights(trimmed)


def test_month_range_validation(spark):
    from knockon.sources import files as SRC
    assert [tuple(r) for r in SRC.month_range(spark, "2023-11", "2024-02").collect()] == [
        (2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    with pytest.raises(ValueError):
        SRC.month_range(spark, "2024-13", "2024-14")
    with pytest.raises(ValueError):
        SRC.month_range(spark, "2024-03", "2024-01")
    assert [tuple(r) for r in SRC.month_list(spark, ["2024-2", "2023-12", "2024-02"]).collect()] == [
        (2023, 12), (2024, 2)]


def test_date_formats(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-1-5",), ("1/5/2024",), ("2024-01-05 00:00:00",),
                                ("20240105",), ("2024-13-01",), ("",), (None,)], "d string")
    got = [r[0] for r in df.select(X.parse_date("d")).collect()]
    assert got[:5] == [dt.date(2024, 1, 5)] * 5
    assert got[5:] == [None, None, None]
