"""Model frame: calendar features, bins, complete cases, year window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.functions import scalar as X

MODEL_COLUMNS = [
    "current_DEP_DELAY", "prev_ARR_DELAY", "scheduled_turnaround_minutes",
    "current_sched_dep_hour", "current_DISTANCE", "OP_UNIQUE_CARRIER", "current_dep_delayed_15",
    "current_year", "current_month", "current_day_of_week", "turnaround_bin", "dep_period",
]


def year_window(pairs: DataFrame, start_year=None, end_year=None) -> DataFrame:
    """Inclusive year range on the current flight date (applied after pairing)."""
    y = F.year("current_FL_DATE")
    if start_year is not None:
        pairs = pairs.where(y >= start_year)
    if end_year is not None:
        pairs = pairs.where(y <= end_year)
    return pairs


def add_features(pairs: DataFrame, keep=()) -> DataFrame:
    """Calendar features of the current flight and the turnaround / period bins."""
    return pairs.select(
        *keep,
        "TAIL_NUM", "OP_UNIQUE_CARRIER",
        F.col("current_DEP_DELAY").cast("double").alias("current_DEP_DELAY"),
        F.col("prev_ARR_DELAY").cast("double").alias("prev_ARR_DELAY"),
        F.col("scheduled_turnaround_minutes").cast("double").alias("scheduled_turnaround_minutes"),
        F.col("current_sched_dep_hour").cast("double").alias("current_sched_dep_hour"),
        F.col("current_DISTANCE").cast("double").alias("current_DISTANCE"),
        F.col("current_dep_delayed_15").cast("int").alias("current_dep_delayed_15"),
        F.year("current_FL_DATE").cast("int").alias("current_year"),
        F.month("current_FL_DATE").cast("int").alias("current_month"),
        X.iso_weekday("current_FL_DATE").alias("current_day_of_week"),
        X.turnaround_bin("scheduled_turnaround_minutes").alias("turnaround_bin"),
        X.dep_period("current_sched_dep_hour").alias("dep_period"),
    )


def model_frame(pairs: DataFrame, keep=(), start_year=None, end_year=None) -> DataFrame:
    """Complete cases over the twelve model columns."""
    return add_features(year_window(pairs, start_year, end_year), keep).dropna(subset=MODEL_COLUMNS)


def enough_rows(n: int, minimum: int = S.MIN_MODEL_ROWS) -> int:
    """``n`` if that many complete pairs can be fitted, else an error."""
    if n < minimum:
        raise ValueError(f"models need {minimum} complete pairs, found {n}")
    return n
