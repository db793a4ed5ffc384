"""Pairs month by month: a new month is paired with the last leg of each tail.

The state is one row per tail, its last timed flight with the fields that a pair
takes from the previous flight.  Month m + 1 reads itself and that table, never
the months before.  Pairs need a scheduled departure and a scheduled arrival
before it, and flights without a scheduled departure come last in a chain, so
they are in no pair and leave no state; the appended pairs are exactly those of
a full rebuild.

A flight that departs before the last leg of its tail belongs into months that
are paired already.  Such late rows are refused by name (``LateFlightsError``):
the month has to be rebuilt with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from knockon import schema as S
from knockon.operators import pairs as P
from knockon.operators.chain import order_key
from knockon.session import materialize

TIME = "sched_dep_timestamp"


class LateFlightsError(ValueError):
    """Flights of a new month that depart before their tail's last paired leg."""


def last_legs(flights: DataFrame, tiebreak=()) -> DataFrame:
    """The last timed flight of each tail (all its columns)."""
    order = P.chain_order(tiebreak)
    columns = [F.col(c) for c in flights.columns]
    return (flights.where(F.col(TIME).isNotNull()).groupBy("TAIL_NUM")
            .agg(F.max_by(F.struct(*columns), order_key(order)).alias("leg")).select("leg.*"))


def refuse_late(state: DataFrame, month: DataFrame, tiebreak=(), shown: int = 5) -> None:
    """Raise ``LateFlightsError`` if a flight of ``month`` comes before the last leg of its tail."""
    order = P.chain_order(tiebreak)
    ends = state.select("TAIL_NUM", order_key(order).alias("_end"))
    late = (month.where(F.col(TIME).isNotNull()).join(ends, "TAIL_NUM").where(order_key(order) <= F.col("_end"))
            .groupBy("TAIL_NUM").agg(F.count(F.lit(1)).alias("n"), F.min(TIME).cast("string").alias("first")))
    found = late.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tails")).first()
    if found.tails:
        names = ", ".join(f"{r.TAIL_NUM} from {r['first']}" for r in late.orderBy("TAIL_NUM").limit(shown).collect())
        raise LateFlightsError(f"{found.n} flights of {found.tails} tails depart before the last paired leg: {names}")


def append_month(state: DataFrame | None, month: DataFrame, tiebreak=(), keep=()) -> tuple[DataFrame, DataFrame]:
    """Pairs of a month's clean flights and the state after it (both lazy; ``month`` is read several times)."""
    if state is None:
        return P.flight_pairs(month, tiebreak, keep=keep), last_legs(month, tiebreak)
    refuse_late(state, month, tiebreak)
    both = month.withColumn("_new", F.lit(True)).unionByName(
        state.join(month.select("TAIL_NUM").distinct(), "TAIL_NUM", "left_semi").withColumn("_new", F.lit(False)))
    found = P.pair_candidates(both, tiebreak, keep=[*keep, "_new"]).where(P.connection_filter() & F.col("_new"))
    after = last_legs(state.unionByName(month), tiebreak)
    return found.select(*keep, *S.PAIR_COLUMNS), after


class PairStore:
    """Pairs and states of the months added so far, one Parquet folder a month.

    A month's pairs are written before its state, and the state marks the month as
    done; a run that was cut off is repeated by adding the month again.
    """

    def __init__(self, spark: SparkSession, path: str, tiebreak=(), keep=()):
        self.spark, self.path, self.tiebreak, self.keep = spark, path.rstrip("/"), tiebreak, tuple(keep)

    def _read(self, folder: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(folder)
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def months(self) -> list[str]:
        """Months ('YYYY-MM') that are done, in order."""
        done = self._read(f"{self.path}/done")
        return sorted(r.month for r in done.select("month").distinct().collect()) if done else []

    def add(self, month: str, flights: DataFrame) -> DataFrame:
        """Pair ``flights``, the clean flights of ``month``; returns the month's pairs.

        Months are added in order; the last one may be added again, which replaces it.
        """
        done = self.months()
        before = [m for m in done if m < month]
        if done and month < done[-1]:
            raise LateFlightsError(f"{month} comes before {done[-1]}, which is paired already")
        state = self._read(f"{self.path}/last/month={before[-1]}") if before else None
        flights = materialize(flights, "month")
        pairs, after = append_month(state, flights, self.tiebreak, self.keep)
        pairs.write.mode("overwrite").parquet(f"{self.path}/pairs/month={month}")
        after.write.mode("overwrite").parquet(f"{self.path}/last/month={month}")
        if month not in done:
            self.spark.createDataFrame([(month,)], "month string").write.mode("append").parquet(f"{self.path}/done")
        return self.spark.read.parquet(f"{self.path}/pairs/month={month}")

    def pairs(self) -> DataFrame:
        """Pairs of all months that are done."""
        found = [self.spark.read.parquet(f"{self.path}/pairs/month={m}") for m in self.months()]
        if not found:
            raise ValueError(f"no months under {self.path}")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out
