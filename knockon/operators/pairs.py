"""Previous/current flight pairs of the same tail (one struct lag over the chain)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.functions import scalar as X
from knockon.operators.chain import chain_links, previous

#: The cleaned columns that pairs are made of; row ids come on top.
PAIR_INPUTS = ["TAIL_NUM", "OP_UNIQUE_CARRIER", "FL_DATE", "ORIGIN", "DEST", "route", "DEP_DELAY", "ARR_DELAY", "DISTANCE",
               "sched_dep_hour", "sched_dep_timestamp", "sched_arr_timestamp"]
PREV_FIELDS = ["ORIGIN", "DEST", "route", "ARR_DELAY", "DEP_DELAY", "DISTANCE", "sched_arr_timestamp"]
#: The same with the scheduled times as minutes (``clean_flights(epoch=True)``), which sort and subtract as numbers; route,
#: hour and timestamps are then derived from the pairs.
EPOCH_INPUTS = ["TAIL_NUM", "OP_UNIQUE_CARRIER", "FL_DATE", "ORIGIN", "DEST", "DEP_DELAY", "ARR_DELAY", "DISTANCE",
                "sched_dep_minute", "sched_arr_minute"]
EPOCH_PREV_FIELDS = ["ORIGIN", "DEST", "ARR_DELAY", "DEP_DELAY", "DISTANCE", "sched_arr_minute"]


def chain_order(tiebreak=(), epoch: bool = False) -> list[str]:
    """Sort of one tail's flights: scheduled departure (nulls last), then row id."""
    return ["sched_dep_minute" if epoch else "sched_dep_timestamp", *tiebreak]


def pair_candidates(clean: DataFrame, tiebreak=(), split="auto", keep=(), max_lead: int = 0) -> DataFrame:
    """Every cleaned flight with its previous flight's fields and the pair flags
    (before the connection filter).  ``max_lead`` > 0 also carries the departure
    delays of the next k flights (``next_dep_delay_k``) from the same chain pass,
    so pairs and later-leg views share one shuffle.  ``clean`` has the scheduled times
    as timestamps (``PAIR_INPUTS``) or as minutes (``EPOCH_INPUTS``)."""
    epoch = "sched_dep_minute" in clean.columns
    linked = chain_links(clean, "TAIL_NUM", chain_order(tiebreak, epoch),
                         prev_cols=EPOCH_PREV_FIELDS if epoch else PREV_FIELDS,
                         lead_col="DEP_DELAY" if max_lead else None, max_lead=max_lead, split=split)
    leads = [F.col(f"_next_{k}").alias(f"next_dep_delay_{k}") for k in range(1, max_lead + 1)]
    if epoch:
        dep, arr = F.col("sched_dep_minute"), F.col(previous("sched_arr_minute"))
        route, prev_route = X.route("ORIGIN", "DEST"), X.route(previous("ORIGIN"), previous("DEST"))
        hour, dep_at, arr_at = X.epoch_hour(dep), X.epoch_timestamp(dep), X.epoch_timestamp(arr)
        turnaround = (dep - arr).cast("double")
    else:
        route, prev_route, hour = F.col("route"), F.col(previous("route")), F.col("sched_dep_hour")
        dep_at, arr_at = F.col("sched_dep_timestamp"), F.col(previous("sched_arr_timestamp"))
        turnaround = X.minutes_between(arr_at, dep_at)
    out = linked.select(
        *[F.col(k) for k in keep], *leads,
        F.col("TAIL_NUM"),
        F.col("OP_UNIQUE_CARRIER"),
        F.col("FL_DATE").alias("current_FL_DATE"),
        F.col("ORIGIN").alias("current_ORIGIN"),
        F.col("DEST").alias("current_DEST"),
        route.alias("current_route"),
        hour.alias("current_sched_dep_hour"),
        F.col("DEP_DELAY").alias("current_DEP_DELAY"),
        F.col("ARR_DELAY").alias("current_ARR_DELAY"),
        F.col("DISTANCE").alias("current_DISTANCE"),
        F.col(previous("ORIGIN")).alias("prev_ORIGIN"),
        F.col(previous("DEST")).alias("prev_DEST"),
        prev_route.alias("prev_route"),
        F.col(previous("ARR_DELAY")).alias("prev_ARR_DELAY"),
        F.col(previous("DEP_DELAY")).alias("prev_DEP_DELAY"),
        F.col(previous("DISTANCE")).alias("prev_DISTANCE"),
        arr_at.alias("prev_sched_arr_timestamp"),
        dep_at.alias("current_sched_dep_timestamp"),
        turnaround.alias("scheduled_turnaround_minutes"),
    )
    return (out
            .withColumn("same_airport_connection", X.same_value_flag("prev_DEST", "current_ORIGIN"))
            .withColumn("current_dep_delayed_15", X.flag_over("current_DEP_DELAY"))
            .withColumn("prev_arr_delayed_15", X.flag_over("prev_ARR_DELAY")))


def connection_filter() -> F.Column:
    """Same-airport connection with a scheduled turnaround in [20, 600] minutes."""
    return ((F.col("same_airport_connection") == 1)
            & F.col("scheduled_turnaround_minutes").between(S.TURNAROUND_MIN, S.TURNAROUND_MAX))


def flight_pairs(clean: DataFrame, tiebreak=(), split="auto", keep=()) -> DataFrame:
    """The 22-column pair table (plus ``keep`` columns in front)."""
    cand = pair_candidates(clean, tiebreak, split, keep)
    return cand.where(connection_filter()).select(*keep, *S.PAIR_COLUMNS)


def pair_summary(clean: DataFrame, by=(), tiebreak=(), split="auto") -> DataFrame:
    """Raw rows, candidate pairs (previous arrival time known) and output pairs."""
    carry = [b for b in by if isinstance(b, str) and b in clean.columns
             and b not in ("TAIL_NUM", "OP_UNIQUE_CARRIER")]
    cand = pair_candidates(clean, tiebreak, split, keep=carry)
    aggs = [F.count(F.lit(1)).alias("raw_rows"),
            F.count("prev_sched_arr_timestamp").alias("candidate_pairs"),
            F.count(F.when(F.col("same_airport_connection") == 1, F.lit(1))).alias("same_airport_pairs"),
            F.count(F.when(connection_filter(), F.lit(1))).alias("output_pairs")]
    return cand.groupBy(*by).agg(*aggs) if by else cand.agg(*aggs)


def partition_ids(clean: DataFrame, n_partitions: int = S.DEFAULT_TAIL_PARTITIONS) -> DataFrame:
    """Stable tail bucket id: crc32(trim(tail)) % n (null tail -> 0)."""
    return clean.withColumn("partition_id", X.tail_bucket("TAIL_NUM", n_partitions))


def partition_stats(clean: DataFrame, n_partitions: int = S.DEFAULT_TAIL_PARTITIONS) -> DataFrame:
    """Rows assigned per tail bucket."""
    return (partition_ids(clean, n_partitions).groupBy("partition_id")
            .agg(F.count(F.lit(1)).alias("rows")))


def chain_sort(clean: DataFrame, tiebreak=(), split="auto") -> DataFrame:
    """Each flight with its 1-based position in its tail's chain (scheduled departure,
    nulls last, then row id)."""
    linked = chain_links(clean, "TAIL_NUM", chain_order(tiebreak), split=split, position=True)
    return linked.drop("_prev").withColumnRenamed("_pos", "chain_position")
