"""Tables written and counted in one pass, and guards on what was counted.

The counts are observed behind the last exchange, in the tasks that write.
Spark takes such a task's counts once, also where an executor is lost and the
task runs again; counts observed in front of an exchange could be added twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.operators import clean as C
from knockon.operators import pairs as P
from knockon.sources import files as SRC


class TooFewRowsError(ValueError):
    """A step wrote fewer rows than the next one needs."""


def require_rows(counts: dict[str, int], name: str, minimum: int = 1) -> int:
    """The count ``name`` if it is large enough, else an error that names it."""
    if counts[name] < minimum:
        raise TooFewRowsError(f"{name}: {minimum} needed, {counts[name]} found")
    return counts[name]


def write_counted(rows: DataFrame, path: str, counts: dict[str, Column], gather: list[str], by: list[str],
                  written: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Write ``written(rows)`` partitioned by ``by``; the ``counts`` over all ``rows`` come from the same pass.

    Rows equal in ``gather`` meet in few files.  ``written`` may filter and project
    but not shuffle.  No rows give zero counts.
    """
    seen = Observation()
    observed = rows.hint("rebalance", *gather).observe(seen, *[c.alias(name) for name, c in counts.items()])
    written(observed).write.mode("overwrite").partitionBy(*by).parquet(path)
    found = seen.get
    return {name: int(found.get(name) or 0) for name in counts}


def _holds(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def write_clean(raw: DataFrame, path: str, keep=()) -> dict[str, int]:
    """Clean ``raw`` into Parquet by year and month; rows in, rows out and nulls of every required column.

    Rows with an unreadable date lie in no month and are counted with the others.
    """
    typed = C.coerce_types(raw, keep)
    passes = C.valid_keys(typed) & C.operated()
    placed = typed.withColumns({"_year": F.year("FL_DATE"), "_month": F.month("FL_DATE"), "_passes": passes})
    counts = {"input_rows": F.count(F.lit(1)), "output_rows": _holds(F.col("_passes")),
              **{f"missing_{c}": _holds(F.col(c).isNull()) for c in S.REQUIRED_COLUMNS}}

    def written(rows: DataFrame) -> DataFrame:
        clean = C.derive_schedule(rows.where("_passes").drop("_passes", "_year", "_month"))
        return clean.withColumn("year", F.year("FL_DATE"))

    return write_counted(placed, path, counts, ["_year", "_month"], ["year", "month"], written)


def clean_summary(spark: SparkSession, path: str, counts: dict[str, int]) -> DataFrame:
    """The counts of ``write_clean`` as one row, with the distinct tails of the one column read back."""
    row = spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))
    if not counts["output_rows"]:
        return row.withColumn("distinct_tail_numbers", F.lit(0).cast("long"))
    tails = spark.read.parquet(path).agg(F.count_distinct("TAIL_NUM")).first()[0]
    return row.withColumn("distinct_tail_numbers", F.lit(tails).cast("long"))


def write_pairs(clean: DataFrame, path: str, tiebreak=(), split="auto", keep=()) -> dict[str, int]:
    """Pair ``clean`` into Parquet by the current flight's year; rows, candidates and pairs from the same pass."""
    cand = P.pair_candidates(clean, tiebreak, split, keep)
    placed = cand.withColumns({"current_year": F.year("current_FL_DATE"), "_connects": P.connection_filter()})
    counts = {"raw_rows": F.count(F.lit(1)), "candidate_pairs": F.count("prev_sched_arr_timestamp"),
              "same_airport_pairs": _holds(F.col("same_airport_connection") == 1),
              "output_pairs": _holds(F.col("_connects"))}
    return write_counted(placed, path, counts, ["current_year"], ["current_year"], lambda rows: rows.where("_connects").select(
        *keep, *S.PAIR_COLUMNS, "current_year"))


def missing_columns(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, missing): of every monthly file the required columns that its header has no name for; one scan."""
    files = SRC.expand(spark, paths)
    if not files:
        raise FileNotFoundError(f"no monthly files under {paths}")
    rows = [(path, [c for c in S.REQUIRED_COLUMNS if c not in C.known_columns(header)])
            for header, group in SRC.headers_of(spark, files).items() for path in group]  # one row a file
    return spark.createDataFrame(rows, "path string, missing array<string>")
