"""The stream reads every file by its own header; the job refuses half a month range; the entry ships the package."""

import csv
import glob
import os
import subprocess
import sys

import pytest

from knockon.operators import clean as C
from knockon.plans import job
from knockon.sources import files as SRC
from knockon.streaming import ingest as ST

HEADER = ["TAIL_NUM", "FL_DATE", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "CRS_DEP_TIME", "CRS_ARR_TIME", "DEP_DELAY",
          "ARR_DELAY", "DISTANCE", "CANCELLED", "DIVERTED"]
ROW = dict(zip(HEADER, ["N1", "2024-01-05", "AA", "JFK", "LAX", "0900", "1200", "5", "-7", "2475", "0", "0"]))


def write(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows([[r.get(c, "") for c in header] for r in rows])


def swapped():
    order = list(HEADER)
    for a, b in (("ORIGIN", "DEST"), ("DEP_DELAY", "ARR_DELAY")):
        i, j = order.index(a), order.index(b)
        order[i], order[j] = order[j], order[i]
    return order


def test_second_header_layout_is_not_read_by_the_first(spark, tmp_path):
    landing, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    write(f"{landing}/a.csv", HEADER, [ROW])
    write(f"{landing}/b.csv", swapped(), [{**ROW, "TAIL_NUM": "N2"}])
    ST.run_clean_ingest(spark, landing, out, ck)
    write(f"{landing}/later/c.csv", [*swapped(), "MONTH", "DAY_OF_WEEK", ""], [
        {**ROW, "TAIL_NUM": "N3", "MONTH": "1", "DAY_OF_WEEK": "5"}])
    ST.run_clean_ingest(spark, landing, out, ck)
    ST.run_clean_ingest(spark, landing, out, ck)  # nothing new
    rows = spark.read.parquet(out).collect()
    assert sorted(r.TAIL_NUM for r in rows) == ["N1", "N2", "N3"]
    assert {(r.ORIGIN, r.DEST, r.DEP_DELAY, r.ARR_DELAY, r.month, r.day_of_week) for r in rows} == {
        ("JFK", "LAX", 5.0, -7.0, 1, 5)}
    assert len(glob.glob(f"{out}/batch=*")) == 2


def test_file_without_a_required_column_stops_the_stream(spark, tmp_path):
    landing, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    write(f"{landing}/good.csv", HEADER, [ROW])
    write(f"{landing}/short.csv", [c for c in HEADER if c != "DEST"], [ROW])
    with pytest.raises(Exception, match=r"short\.csv has no column for DEST"):
        ST.run_clean_ingest(spark, landing, out, ck)
    write(f"{landing}/short.csv", HEADER, [ROW])
    ST.run_clean_ingest(spark, landing, out, ck)  # the batch is repeated with the mended file
    assert spark.read.parquet(out).count() == 2


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(30):
        write(f"{tmp_path}/f{i:02d}.csv", HEADER if i % 3 else swapped(), [ROW] * (i % 4))
    with open(f"{tmp_path}/f99.csv", "w") as blank:
        blank.write("\n")
    files = SRC.expand(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("headers", "headers")
    groups = SRC.headers_of(spark, files)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {k: len(v) for k, v in groups.items()} == {tuple(HEADER): 20, tuple(swapped()): 10, (): 1}
    assert len(jobs) <= 4  # stages of one query, however many files
    with pytest.raises(C.MissingColumnsError, match="f99"):
        SRC.read_month_csv(spark, str(tmp_path))


def test_half_a_month_range_is_an_error(spark, tmp_path):
    for half in ({"start": "2024-01"}, {"end": "2024-02"}):
        with pytest.raises(ValueError, match="both ends"):
            job.run_job(spark, str(tmp_path), f"{tmp_path}/out", **half)


def test_entry_runs_python_steps_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "import __spark_entry__ as E\n"
            "from knockon.session import get_spark\n"
            "spark = get_spark('entry', master='local[2]', shuffle_partitions=2)\n"
            "print('rows', E.queries()['read_month_zip'](spark, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
