"""Monthly raw files: discovery, source choice, CSV / ZIP ingest, layouts on disk.

Raw monthly files are read with Spark's CSV reader (all columns as text, then
typed by the clean step).  ZIP archives holding one CSV are ingested by a
``binaryFile`` scan: one task per archive unzips and parses its member, so
archives are read in parallel and nothing passes through the driver.
Outputs are Parquet datasets partitioned by year/month (clean flights), by
year (pairs) or by tail bucket, so later reads prune partitions.
"""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.functions import scalar as X
from knockon.operators import clean as C

# Accepted monthly file-name patterns (matched at the end of the
# file name, case-insensitive); group 1 = year, group 2 = month.
MONTH_PATTERNS = [
    r"flight_data_(\d{4})_(\d{2})\.csv$",
    r"On_Time_Reporting_Carrier_On_Time_Performance_1987_present_(\d{4})_(\d{1,2})\.zip$",
    r"On_Time_Reporting_Carrier_On_Time_Performance_1987_present_(\d{4})_(\d{1,2})\.csv$",
    r"On_Time_Reporting_Carrier_On_Time_Performance_\(1987_present\)_(\d{4})_(\d{1,2})\.csv$",
    r"airlines_(\d{4})_(\d{1,2})\.csv$",
]


def _name(path):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def month_of_path(path_col: str = "path") -> tuple:
    """(year, month) int columns parsed from the file name; null when no pattern matches."""
    name = _name(F.col(path_col))
    ys, ms = [], []
    for pat in MONTH_PATTERNS:
        p = "(?i)" + pat
        hit = name.rlike(p)
        ys.append(F.when(hit, F.regexp_extract(name, p, 1).cast("int")))
        ms.append(F.when(hit, F.regexp_extract(name, p, 2).cast("int")))
    return F.coalesce(*ys), F.coalesce(*ms)


def source_priority(path_col: str = "path"):
    """CSV under /data/csv/ (0) < ZIP (1) < other CSV (2) < anything else (9)."""
    path = F.col(path_col)
    low = F.lower(_name(path))
    return (F.when(low.endswith(".csv") & path.contains("/data/csv/"), 0)
            .when(low.endswith(".zip"), 1)
            .when(low.endswith(".csv"), 2)
            .otherwise(9))


def source_pick(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """One preferred source per (year, month): lowest priority, then shorter name,
    then path; sorted by month."""
    y, m = month_of_path(path_col)
    c = paths.select(F.col(path_col).alias("path"), y.alias("year"), m.alias("month"))
    c = c.where(F.col("year").isNotNull()).withColumn("priority", source_priority("path"))
    w = Window.partitionBy("year", "month").orderBy(
        "priority", F.length(_name(F.col("path"))), "path")
    return (c.withColumn("_rk", F.row_number().over(w)).where("_rk = 1")
            .select("year", "month", "path").orderBy("year", "month"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Recursive file listing (path only) via the binaryFile source; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root).select("path"))


def _month_number(text: str) -> int:
    """Months since year 0 of a 'YYYY-MM' value."""
    year, _, month = text.strip().partition("-")
    if not (len(year) == 4 and year.isdecimal() and month.isdecimal() and len(month) <= 2 and 0 < int(month) < 13):
        raise ValueError(f"{text!r} is not a month; write it as 2024-01")
    return int(year) * 12 + int(month) - 1


def _months(numbers: DataFrame) -> DataFrame:
    return numbers.select(F.expr("id div 12").cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All months from ``start`` to ``end``, both 'YYYY-MM' and both included."""
    first, last = _month_number(start), _month_number(end)
    if first > last:
        raise ValueError(f"month range runs backwards: {start} to {end}")
    return _months(spark.range(first, last + 1))


def month_list(spark: SparkSession, values: list[str]) -> DataFrame:
    """The given 'YYYY-MM' months, each once, in order."""
    numbers = sorted({_month_number(v) for v in values})
    return _months(spark.createDataFrame([(n,) for n in numbers], "id long"))


# ------------------------------------------------------------------ raw readers
def _strip_bom(df: DataFrame) -> DataFrame:
    ren = {c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")}
    for a, b in ren.items():
        df = df.withColumnRenamed(a, b)
    return df


def expand(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """The files behind files, folders and globs (a listing; nothing is read)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
              .select("path").distinct().orderBy("path"))
    return [r.path for r in listed.toLocalIterator()]


def headers_of(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header row, in one job: a text scan keeps the first line of each file.

    A file's first block is read by one task, where its lines are numbered in order;
    the least number of a file is its header, whatever blocks share the task.
    """
    lines = (spark.read.text(files)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("place"), "value"))
    first = (lines.where("block = 0").groupBy("path").agg(F.min_by("value", "place").alias("header")))
    found = {r.path: r.header for r in first.collect()}  # one row a file
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in files:
        header = next(csv.reader([(found.get(path) or "").lstrip("\ufeff")]), [])
        groups.setdefault(tuple(header), []).append(path)
    return groups


def read_month_csv(spark: SparkSession, paths: list[str] | str, with_source: bool = False) -> DataFrame:
    """Raw monthly CSV files, folders or globs with canonical columns (text).

    Every file is read by its own header: files are grouped by header row, each
    group is one scan, and a group without month or weekday gets them from the
    flight date.  Unnamed trailing columns are dropped.  ``with_source`` adds
    ``source_path`` (the file each row came from).
    """
    files = expand(spark, paths)
    if not files:
        raise FileNotFoundError(f"no monthly files under {paths}")
    keep = ["source_path"] if with_source else []
    frames = []
    for header, group in headers_of(spark, files).items():
        absent = [c for c in S.REQUIRED_COLUMNS if c not in C.known_columns(header)]
        if absent:
            raise C.MissingColumnsError(f"{group[0]} has no column for {', '.join(absent)}")
        df = _strip_bom(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(group))
        df = df.select([c for c in df.columns if not (c.startswith("_c") or c.startswith("Unnamed:"))]
                       + [F.col("_metadata.file_path").alias(c) for c in keep])
        frames.append(C.fill_calendar(C.to_canonical(df, keep=keep)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_month_zip(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Raw monthly ZIP archives with one CSV file each, canonical columns as text plus ``source_path``.

    A task unzips the archives it scanned and parses them in chunks; the bytes
    are not shuffled.  Month and weekday come from the flight date where an
    archive has no such column.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    wanted = S.REQUIRED_COLUMNS + S.OPTIONAL_COLUMNS
    schema = ", ".join(f"{c} string" for c in (*wanted, "source_path")) + ", _no_month boolean, _no_weekday boolean"
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def unzip(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(only_csv(archive, path)) as member:
                    for chunk in pd.read_csv(io.TextIOWrapper(member, encoding="utf-8-sig"), dtype=str,
                                             keep_default_na=False, chunksize=200_000):
                        yield _canonical_pandas(chunk, wanted, path)

    rows = files.mapInPandas(unzip, schema)
    filled = C.fill_calendar(rows, {"MONTH": F.col("_no_month"), "DAY_OF_WEEK": F.col("_no_weekday")})
    return filled.drop("_no_month", "_no_weekday")


def only_csv(archive: zipfile.ZipFile, path: str) -> str:
    """The archive's CSV file; any other number than one is an error."""
    names = [info.filename for info in archive.infolist() if info.filename[-4:].lower() == ".csv"]
    if len(names) == 1:
        return names[0]
    raise ValueError(f"{path} holds {len(names)} CSV files, one is needed: {names}")


def _canonical_pandas(chunk: pd.DataFrame, wanted: list[str], path: str) -> pd.DataFrame:
    found = C.known_columns(chunk.columns)
    absent = [c for c in S.REQUIRED_COLUMNS if c not in found]
    if absent:
        raise C.MissingColumnsError(f"{path} has no column for {', '.join(absent)}")
    raw = chunk[[found[c] for c in wanted if c in found]]
    out = raw.where(raw != "", None).set_axis([c for c in wanted if c in found], axis=1).reindex(columns=wanted)
    return out.astype(object).where(out.notna(), None).assign(
        source_path=path, _no_month="MONTH" not in found, _no_weekday="DAY_OF_WEEK" not in found)


def trim_columns(df: DataFrame, columns: list[str] = S.TRIM_COLUMNS) -> DataFrame:
    """Project a wide raw file to the fixed column list (error if any is missing);
    short rows (nulls from the permissive reader) become empty strings."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError("archive is missing required columns: " + ", ".join(missing))
    return df.select(*columns).na.fill("", subset=list(columns))


# ------------------------------------------------------------------ sinks
def write_clean(clean: DataFrame, path: str) -> None:
    """Clean flights as Parquet partitioned by year / month of the flight date.

    ``rebalance`` gathers a month's rows and splits months that are large, so a
    month is as many files as its size asks for.
    """
    (clean.withColumn("year", F.year("FL_DATE")).hint("rebalance", "year", "month")
     .write.mode("overwrite").partitionBy("year", "month").parquet(path))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs as Parquet partitioned by the current flight's year (year filters prune).

    ``rebalance`` gathers a year's rows into files of a usual size and splits large years.
    """
    (pairs.withColumn("current_year", F.year("current_FL_DATE")).hint("rebalance", "current_year")
     .write.mode("overwrite").partitionBy("current_year").parquet(path))


def read_pairs(spark: SparkSession, path: str, columns: list[str] | None = None,
               start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Pairs with column pruning and an inclusive year range (partition pruning)."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no pairs under {path}")
    if start_year is not None:
        df = df.where(F.col("current_year") >= start_year)
    if end_year is not None:
        df = df.where(F.col("current_year") <= end_year)
    return df.select(*columns) if columns else df


def write_tail_partitions(clean: DataFrame, path: str,
                          n_partitions: int = S.DEFAULT_TAIL_PARTITIONS) -> None:
    """Clean flights laid out by stable tail bucket (crc32 of the stripped tail, modulo n); large buckets split."""
    (clean.withColumn("partition_id", X.tail_bucket("TAIL_NUM", n_partitions))
     .hint("rebalance", "partition_id")
     .write.mode("overwrite").partitionBy("partition_id").parquet(path))
