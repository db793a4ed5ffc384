"""Raw monthly file handling: BOM, alias headers, trailing comma, mixed headers, ZIP."""

import io
import os
import tempfile
import zipfile

import pytest

from knockon.operators import clean as C
from knockon.sources import files as SRC

LONG = ("Tail_Number,FlightDate,Reporting_Airline,Origin,Dest,CRSDepTime,CRSArrTime,DepDelay,ArrDelay,"
        "Distance,Cancelled,Diverted,\n")
SHORT = ("TAIL_NUM,FL_DATE,OP_UNIQUE_CARRIER,ORIGIN,DEST,CRS_DEP_TIME,CRS_ARR_TIME,DEP_DELAY,ARR_DELAY,"
         "DISTANCE,CANCELLED,DIVERTED\n")


@pytest.fixture(scope="module")
def month_dir():
    d = tempfile.mkdtemp(prefix="knockon-src-")
    with open(os.path.join(d, "airlines_2024_1.csv"), "w", encoding="utf-8") as f:
        f.write("\ufeff" + LONG)
        f.write("N1 ,2024-01-02,AA,S1,S2,0900,1000,5,7,300,0,0,\n")
        f.write("N2,2024-01-02,AA,S1,S2,2400,0110,,7,300,0,0,\n")
    with open(os.path.join(d, "flight_data_2024_02.csv"), "w", encoding="utf-8") as f:
        f.write(SHORT)
        f.write("N1,2024-02-03,BB,S2,S3,0800,0900,1,2,100,1,0\n")
        f.write("N3,2024-02-03,BB,S2,S3,0800,0900,1,2,100,0,0\n")
    buf = io.StringIO()
    buf.write("\ufeff" + LONG + "N4,2024-03-04,CC,S3,S4,1000,1130,3,4,500,0,0,\n")
    with zipfile.ZipFile(os.path.join(d, "On_Time_Reporting_Carrier_On_Time_Performance_1987_present_2024_3.zip"), "w") as z:
        z.writestr("On_Time_2024_3.csv", buf.getvalue())
    return d


def test_read_month_csv_mixed_headers(spark, month_dir):
    paths = [os.path.join(month_dir, f) for f in ("airlines_2024_1.csv", "flight_data_2024_02.csv")]
    raw = SRC.read_month_csv(spark, paths)
    assert set(raw.columns) == {*C.S.REQUIRED_COLUMNS, "MONTH", "DAY_OF_WEEK"}  # filled per file
    rows = {r.TAIL_NUM: r for r in C.clean_flights(raw).collect()}
    assert sorted(rows) == ["N1", "N2", "N3"]          # the cancelled February N1 row is dropped
    assert rows["N2"].DEP_DELAY is None and rows["N2"].sched_dep_hour == 0   # 2400 -> next day 00:00


def test_read_month_zip(spark, month_dir):
    raw = SRC.read_month_zip(spark, [os.path.join(month_dir, "*.zip")])
    r = C.clean_flights(raw).collect()
    assert len(r) == 1 and r[0].TAIL_NUM == "N4" and r[0].route == "S3-S4"


def test_source_pick_over_listing(spark, month_dir):
    listing = SRC.list_files(spark, month_dir)
    picked = [(r.year, r.month) for r in SRC.source_pick(listing).collect()]
    assert picked == [(2024, 1), (2024, 2), (2024, 3)]
