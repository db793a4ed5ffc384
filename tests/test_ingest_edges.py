"""Raw files as they come: headers per file, dates with times, odd numbers and white space."""

import datetime as dt
import os
import subprocess
import sys
import zipfile
import zlib

import numpy as np
import pytest

from knockon.functions import scalar as X
from knockon.operators import clean as C
from knockon.plans import job
from knockon.sources import files as SRC

HEADER = ["Tail_Number", "FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime", "CRSArrTime", "DepDelay",
          "ArrDelay", "Distance", "Cancelled", "Diverted"]
ROW = ["N1", "2024-01-05", "AA", "S1", "S2", "0900", "1000", "5", "7", "300", "0", "0"]


def write(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for row in [header, *rows]:
            f.write(",".join(f'"{v}"' for v in row) + "\n")


def test_headers_are_read_per_file_in_folders(spark, tmp_path):
    swapped = list(HEADER)
    swapped[3], swapped[4], swapped[7], swapped[8] = swapped[4], swapped[3], swapped[8], swapped[7]
    write(f"{tmp_path}/m/a.csv", HEADER, [ROW])
    write(f"{tmp_path}/m/sub/b.csv", swapped, [["N2", "2024-02-06", "AA", "S9", "S8", "0900", "1000", "70", "50", "1", "0", "0"]])
    write(f"{tmp_path}/m/c.csv", HEADER + ["Month", "DayOfWeek"], [["N3", *ROW[1:], "7", "3"]])
    for paths in (f"{tmp_path}/m", [f"{tmp_path}/m/*.csv", f"{tmp_path}/m/sub"]):
        rows = {r.TAIL_NUM: r for r in C.clean_flights(SRC.read_month_csv(spark, paths)).collect()}
        assert (rows["N2"].ORIGIN, rows["N2"].DEST, rows["N2"].ARR_DELAY, rows["N2"].DEP_DELAY) == ("S8", "S9", 70.0, 50.0)
        assert (rows["N1"].month, rows["N1"].day_of_week) == (1, 5)
        assert (rows["N2"].month, rows["N2"].day_of_week) == (2, 2)
        assert (rows["N3"].month, rows["N3"].day_of_week) == (7, 3)
    with pytest.raises((FileNotFoundError, Exception)):
        SRC.read_month_csv(spark, f"{tmp_path}/none")


def archive(path, header, rows, names=("one.csv",)):
    with zipfile.ZipFile(path, "w") as z:
        for name in names:
            z.writestr(name, "﻿" + "\n".join(",".join(r) for r in [header, *rows]))


def test_zip_months_fill_the_calendar_per_archive(spark, tmp_path):
    archive(f"{tmp_path}/a.zip", HEADER, [ROW])
    archive(f"{tmp_path}/b.zip", HEADER + ["Month", "DayOfWeek"], [["N2", *ROW[1:], "", "4"]])
    rows = {r.TAIL_NUM: r for r in C.clean_flights(SRC.read_month_zip(spark, f"{tmp_path}/*.zip")).collect()}
    assert (rows["N1"].month, rows["N1"].day_of_week) == (1, 5)
    assert (rows["N2"].month, rows["N2"].day_of_week) == (None, 4)
    archive(f"{tmp_path}/c.zip", HEADER, [ROW], names=("one.csv", "two.CSV"))
    with pytest.raises(Exception, match="holds 2 CSV files"):
        SRC.read_month_zip(spark, f"{tmp_path}/c.zip").collect()


def test_dates_may_carry_a_clock(spark):
    good = ["1/5/2024 12:00:00 AM", "1/5/2024 0:00", "2024-01-05T00:00:00", "2024/01/05", "01/05/2024", "\t2024-1-5 ",
            "2024-01-05 23:59:59.999", "20240105", "2024-01-05T10:00:00Z"]
    bad = ["2024-01-05 noon", "5.1.2024", "2024-13-05", "2024-01-05x", "", None]
    df = spark.createDataFrame([(d,) for d in good + bad], "d string")
    got = [r[0] for r in df.select(X.parse_date("d")).collect()]
    assert got == [dt.date(2024, 1, 5)] * len(good) + [None] * len(bad)


def test_numbers_are_plain_numbers(spark):
    cases = {"5D": None, "5f": None, "1,000": None, "0x10": None, "": None, "nan": None, " 5 ": 5.0, "\t-3.5 ": -3.5,
             ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "Infinity": float("inf"), "-inf": float("-inf"), "1_0": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(X.coerce_double("t")).collect()] == list(cases.values())


def test_white_space_is_stripped_like_text(spark):
    tails = ["N1\t", " N1", "N1 ", "\n N1 \r\n", "N1"]
    df = spark.createDataFrame([(t,) for t in tails], "t string")
    assert {r[0] for r in df.select(X.strip("t")).collect()} == {"N1"}
    assert {r[0] for r in df.select(X.tail_bucket("t", 100)).collect()} == {zlib.crc32(b"N1") % 100}


def test_month_beyond_integers_is_null(spark):
    rows = [(*ROW, "1e12", "x")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*HEADER, "Month", "DayOfWeek"]))
    r = C.clean_flights(df).first()
    assert (r.month, r.day_of_week) == (None, None)


def flights(n, months, seed=3):
    """Rows of a few tails that fly back and forth; a delay passes on in part."""
    draw = np.random.default_rng(seed)
    rows = {}
    for tail in range(12):
        late = 0.0
        for i in range(n):
            month = months[i * len(months) // n]
            day, hour = 1 + (i // 4) % 27, 6 + 4 * (i % 4)
            late = 0.6 * late + draw.gamma(1.2, 14) - 8
            out, back = ("S0", "S1") if i % 2 == 0 else ("S1", "S0")
            rows.setdefault(month, []).append([
                f"N{tail}", f"2024-{month:02d}-{day:02d}", f"C{tail % 3}", out, back, f"{hour:02d}00",
                f"{hour + 2:02d}30", f"{late:.0f}", f"{late + draw.normal(0, 4):.0f}", "500", "0", "0"])
    return rows


def test_the_whole_job_on_files(spark, tmp_path):
    months = flights(320, [1, 2, 3])
    root = f"{tmp_path}/in"
    write(f"{root}/flight_data_2024_01.csv", HEADER, months[1])
    write(f"{root}/airlines_2024_2.csv", HEADER + [""], [[*r, ""] for r in months[2]])
    archive(f"{root}/On_Time_Reporting_Carrier_On_Time_Performance_1987_present_2024_3.zip", HEADER, months[3])
    write(f"{root}/readme.csv", ["x"], [["1"]])
    out = f"{tmp_path}/out"
    reports = job.run_job(spark, root, out, replicates=3)
    clean = spark.read.parquet(f"{out}/clean")
    assert clean.count() == sum(map(len, months.values()))
    assert {r.month for r in clean.select("month").distinct().collect()} == {1, 2, 3}
    summary = reports["final_summary"].first()
    assert summary.total_cleaned_flights == clean.count() and summary.total_raw_files_used == 3
    assert summary.main_carryover_coefficient > 0.2 and summary.bootstrap_ci_lower < summary.bootstrap_ci_upper
    assert os.path.isdir(f"{out}/reports/airline_carryover")
    only = job.chosen_sources(spark, root, SRC.month_range(spark, "2024-02", "2024-03")).collect()
    assert [r.month for r in only] == [2, 3]


def test_empty_inputs_are_errors(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    with pytest.raises(Exception):
        job.run_job(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    spark.createDataFrame([], "a int, current_year int").write.parquet(f"{tmp_path}/pairs")
    with pytest.raises(ValueError):
        SRC.read_pairs(spark, f"{tmp_path}/pairs")


def test_steps_run_from_another_folder(tmp_path):
    """The package reaches Python workers when the driver was started elsewhere."""
    archive(f"{tmp_path}/a.zip", HEADER, [ROW])
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from knockon.session import get_spark, ship_package\n"
            "from knockon.sources import files\n"
            "spark = get_spark('ship', master='local[2]', shuffle_partitions=2)\n"
            "ship_package(spark)\n"
            f"print('rows', files.read_month_zip(spark, {str(tmp_path / 'a.zip')!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 1" in done.stdout, done.stderr[-2000:]
