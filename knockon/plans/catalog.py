"""Registered queries: name -> (spark builder(spark, sf_dir) -> DataFrame, DuckDB oracle SQL).

Every query reads the driver tables through the flight fixtures, so its work
grows with the tables.  Doubles from aggregations are rounded to 6 places on
both sides (engines sum in different orders).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon.functions import scalar as X
from knockon.operators import clean as C
from knockon.operators import features as FE
from knockon.operators import pairs as P
from knockon.operators.quantiles import exact_quantiles
from knockon.plans.oracle import cte_chain
from knockon.session import materialize, scratch_path
from knockon.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs
def raw_flights(spark, sf, fx="flights") -> DataFrame:
    return FX.fx_flights(spark, sf) if fx == "flights" else FX.fx_lineitem_flights(spark, sf)


def ids(fx="flights") -> list[str]:
    return FX.FX_FLIGHTS_ORDER if fx == "flights" else FX.FX_LINEITEM_ORDER


def clean_of(spark, sf, fx="flights") -> DataFrame:
    """Cleaned flights; nothing runs until they are used."""
    return C.clean_flights(raw_flights(spark, sf, fx), keep=ids(fx))


def stage_of(spark, sf, fx="flights", columns=None) -> DataFrame:
    """Cleaned flights as a written table, for chains, which read their input more than once.

    ``columns``: those that the chain reads besides the row ids; by default all are written.
    """
    clean = clean_of(spark, sf, fx)
    return materialize(clean if columns is None else clean.select(*ids(fx), *columns), "clean")


def pair_stage_of(spark, sf, fx="flights") -> DataFrame:
    """What pairs are made of, as a written table with the scheduled times as minutes."""
    clean = C.clean_flights(raw_flights(spark, sf, fx), keep=ids(fx), epoch=True)
    return materialize(clean.select(*ids(fx), *P.EPOCH_INPUTS), "clean")


def typed_of(spark, sf, fx="flights") -> DataFrame:
    return C.coerce_types(raw_flights(spark, sf, fx), keep=ids(fx))


def cand_of(spark, sf, fx="flights") -> DataFrame:
    return P.pair_candidates(pair_stage_of(spark, sf, fx), tiebreak=ids(fx), keep=ids(fx))


def pairs_of(spark, sf, fx="flights") -> DataFrame:
    return P.flight_pairs(pair_stage_of(spark, sf, fx), tiebreak=ids(fx), keep=ids(fx))


def mf_of(spark, sf, fx="lineitem") -> DataFrame:
    return FE.model_frame(pairs_of(spark, sf, fx), keep=ids(fx))


def r6(c):
    return F.round(c, 6)


# Dates and timestamps leave the registered queries as ISO text (the layout the
# reference writes to its CSV outputs), so both engines present them identically.
TEMPORAL = {"FL_DATE": "date", "current_FL_DATE": "date", "sched_dep_timestamp": "ts",
            "sched_arr_timestamp": "ts", "prev_sched_arr_timestamp": "ts",
            "current_sched_dep_timestamp": "ts", "dep_timestamp": "ts", "arr_timestamp": "ts"}


def iso(df: DataFrame) -> DataFrame:
    """Render date / timestamp columns as 'yyyy-MM-dd' / 'yyyy-MM-dd HH:mm:ss' text."""
    out = []
    for c in df.columns:
        kind = TEMPORAL.get(c)
        if kind == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(c))
        elif kind == "ts":
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def iso_sql(cols: list[str]) -> str:
    """DuckDB select list matching ``iso``."""
    items = []
    for c in cols:
        kind = TEMPORAL.get(c)
        if kind == "date":
            items.append(f"strftime({c}, '%Y-%m-%d') as {c}")
        elif kind == "ts":
            items.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}")
        else:
            items.append(c)
    return ", ".join(items)


W_FL = cte_chain("flights", "clean")
W_FL_P = cte_chain("flights", "pairs")
W_LI_P = cte_chain("lineitem", "pairs")
W_LI_MF = cte_chain("lineitem", "mf")
W_FL_MF = cte_chain("flights", "mf")

# ---------------------------------------------------------------- sources / projections
TYPED_OUT = ["event_id", "TAIL_NUM", "FL_DATE", "CRS_DEP_TIME", "CRS_ARR_TIME", "DEP_DELAY", "ARR_DELAY",
             "DISTANCE", "CANCELLED", "DIVERTED"]
query("coerce_types", W_FL + "select " + iso_sql(TYPED_OUT) + " from typed")(
    lambda spark, sf: iso(typed_of(spark, sf).select(*TYPED_OUT)))

RESOLVED_OUT = ["event_id", "TAIL_NUM", "FL_DATE", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST"]
query("resolve_columns", W_FL + "select " + iso_sql(RESOLVED_OUT) + " from typed")(
    lambda spark, sf: iso(typed_of(spark, sf).select(*RESOLVED_OUT)))

query("filter_valid_keys", W_FL + """
select event_id, TAIL_NUM, strftime(FL_DATE, '%Y-%m-%d') as FL_DATE from typed
where TAIL_NUM is not null and TAIL_NUM <> '' and FL_DATE is not null
  and CRS_DEP_TIME is not null and CRS_ARR_TIME is not null""")(
    lambda spark, sf: (lambda t: iso(t.where(C.valid_keys(t)).select("event_id", "TAIL_NUM", "FL_DATE")))(
        typed_of(spark, sf)))

query("filter_operated", W_FL + """
select event_id, CANCELLED, DIVERTED from typed
where coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1""")(
    lambda spark, sf: typed_of(spark, sf).where(C.operated()).select("event_id", "CANCELLED", "DIVERTED"))


@query("hhmm_ts", W_FL.replace("from kept)", "from typed)", 1) + """
select event_id, strftime(dep_ts, '%Y-%m-%d %H:%M:%S') as dep_timestamp,
 strftime(arr_ts0, '%Y-%m-%d %H:%M:%S') as arr_timestamp from hh4""")
def q_hhmm_ts(spark, sf):
    t = typed_of(spark, sf)
    return iso(t.select("event_id", X.hhmm_timestamp("FL_DATE", "CRS_DEP_TIME").alias("dep_timestamp"),
                        X.hhmm_timestamp("FL_DATE", "CRS_ARR_TIME").alias("arr_timestamp")))


@query("sched_hours", W_FL.replace("from kept)", "from typed)", 1) + """
select event_id, cast(case when dv and FL_DATE is not null then dc // 100 end as double) as dep_hour,
 cast(case when av and FL_DATE is not null then ac // 100 end as double) as arr_hour from hh4""")
def q_sched_hours(spark, sf):
    # nullable hours leave as double: both engines then hand the same column kind to pandas
    t = typed_of(spark, sf)
    return t.select("event_id", X.hhmm_hour("FL_DATE", "CRS_DEP_TIME").cast("double").alias("dep_hour"),
                    X.hhmm_hour("FL_DATE", "CRS_ARR_TIME").cast("double").alias("arr_hour"))


query("overnight_fix", W_FL + "select " + iso_sql(["event_id", "sched_dep_timestamp", "sched_arr_timestamp"])
      + " from clean")(lambda spark, sf: iso(clean_of(spark, sf).select(
          "event_id", "sched_dep_timestamp", "sched_arr_timestamp")))

query("calendar_fill", W_FL + "select event_id, month, day_of_week from clean")(
    lambda spark, sf: clean_of(spark, sf).select("event_id", "month", "day_of_week"))

query("route", W_FL + "select event_id, route from clean")(
    lambda spark, sf: clean_of(spark, sf).select("event_id", "route"))

CLEAN_COLS = ["event_id", "TAIL_NUM", "FL_DATE", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST",
              "CRS_DEP_TIME", "CRS_ARR_TIME", "DEP_DELAY", "ARR_DELAY", "DISTANCE", "CANCELLED",
              "DIVERTED", "sched_dep_hour", "sched_arr_hour", "month", "day_of_week", "route",
              "sched_dep_timestamp", "sched_arr_timestamp"]
query("clean_flights", W_FL + "select " + iso_sql(CLEAN_COLS).replace(
    "sched_dep_hour, sched_arr_hour", "cast(sched_dep_hour as double) as sched_dep_hour, "
    "cast(sched_arr_hour as double) as sched_arr_hour") + " from clean")(
    lambda spark, sf: iso(clean_of(spark, sf).select(*CLEAN_COLS)).withColumn(
        "sched_dep_hour", F.col("sched_dep_hour").cast("double")).withColumn(
        "sched_arr_hour", F.col("sched_arr_hour").cast("double")))


@query("clean_summary", W_FL + """
select cast(count(*) as bigint) as input_rows,
 cast(count(*) filter (where TAIL_NUM is not null and TAIL_NUM <> '' and FL_DATE is not null
   and CRS_DEP_TIME is not null and CRS_ARR_TIME is not null
   and coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1) as bigint) as output_rows,
 cast(count(distinct case when TAIL_NUM is not null and TAIL_NUM <> '' and FL_DATE is not null
   and CRS_DEP_TIME is not null and CRS_ARR_TIME is not null
   and coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1 then TAIL_NUM end) as bigint)
   as distinct_tail_numbers,
""" + ",\n".join(f" cast(count(*) filter (where {c} is null) as bigint) as missing_{c}"
                 for c in C.S.REQUIRED_COLUMNS) + " from typed")
def q_clean_summary(spark, sf):
    return C.clean_summary(raw_flights(spark, sf), keep=ids())


@query("clean_summary_by_month", cte_chain("lineitem", "clean") + """
select strftime(FL_DATE, '%Y-%m') as input_month, cast(count(*) as bigint) as input_rows,
 cast(count(*) filter (where coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1) as bigint)
   as output_rows,
 cast(count(distinct case when coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1
   then TAIL_NUM end) as bigint) as distinct_tail_numbers
from typed group by 1""")
def q_clean_summary_by_month(spark, sf):
    s = C.clean_summary(raw_flights(spark, sf, "lineitem"),
                        by=[F.date_format("FL_DATE", "yyyy-MM").alias("input_month")],
                        keep=ids("lineitem"))
    return s.select("input_month", "input_rows", "output_rows", "distinct_tail_numbers")


# ---------------------------------------------------------------- pairs
PAIR_OUT = ["event_id", *C.S.PAIR_COLUMNS]
query("flight_pairs", W_FL_P + "select " + iso_sql(PAIR_OUT) + " from pairs")(
    lambda spark, sf: iso(pairs_of(spark, sf).select(*PAIR_OUT)))

LI_PAIR_OUT = [*FX.FX_LINEITEM_ORDER, *C.S.PAIR_COLUMNS]
query("flight_pairs_multi_year", W_LI_P + "select " + iso_sql(LI_PAIR_OUT) + " from pairs")(
    lambda spark, sf: iso(pairs_of(spark, sf, "lineitem").select(*LI_PAIR_OUT)))

TURN_OUT = ["event_id", "prev_sched_arr_timestamp", "current_sched_dep_timestamp",
            "scheduled_turnaround_minutes"]
query("turnaround_minutes", W_FL_P + "select " + iso_sql(TURN_OUT) + " from cand")(
    lambda spark, sf: iso(cand_of(spark, sf).select(*TURN_OUT)))

query("same_airport", W_FL_P + "select event_id, prev_DEST, current_ORIGIN, same_airport_connection from cand")(
    lambda spark, sf: cand_of(spark, sf).select("event_id", "prev_DEST", "current_ORIGIN",
                                                "same_airport_connection"))

query("delay_flags", W_FL_P + """
select event_id, current_DEP_DELAY, prev_ARR_DELAY, current_dep_delayed_15, prev_arr_delayed_15 from cand""")(
    lambda spark, sf: cand_of(spark, sf).select("event_id", "current_DEP_DELAY", "prev_ARR_DELAY",
                                                "current_dep_delayed_15", "prev_arr_delayed_15"))

query("filter_connection", W_FL_P + """
select event_id, same_airport_connection, scheduled_turnaround_minutes from pairs""")(
    lambda spark, sf: pairs_of(spark, sf).select("event_id", "same_airport_connection",
                                                 "scheduled_turnaround_minutes"))

query("pair_summary", W_FL_P + """
select OP_UNIQUE_CARRIER, cast(count(*) as bigint) as raw_rows,
 cast(count(prev_sched_arr_timestamp) as bigint) as candidate_pairs,
 cast(count(*) filter (where same_airport_connection = 1) as bigint) as same_airport_pairs,
 cast(count(*) filter (where same_airport_connection = 1
   and scheduled_turnaround_minutes between 20 and 600) as bigint) as output_pairs
from cand group by OP_UNIQUE_CARRIER""")(
    lambda spark, sf: P.pair_summary(stage_of(spark, sf), by=["OP_UNIQUE_CARRIER"], tiebreak=ids()))


def _prev_bin_sql(col="prev_ARR_DELAY"):
    e = C.S.PREV_DELAY_EDGES
    labels = X.prev_delay_bin_labels()
    parts = [f"when {col} >= {e[0]} and {col} <= {e[1]} then '{labels[0]}'"]
    parts += [f"when {col} > {e[i]} and {col} <= {e[i + 1]} then '{labels[i]}'"
              for i in range(1, len(labels))]
    idx = [f"when {col} >= {e[0]} and {col} <= {e[1]} then 0"]
    idx += [f"when {col} > {e[i]} and {col} <= {e[i + 1]} then {i}" for i in range(1, len(labels))]
    return "case " + " ".join(parts) + " end", "case " + " ".join(idx) + " end"


_BIN, _BIN_IDX = _prev_bin_sql()
DELAY_RATE_SQL = f"""
select prev_delay_bin, cast(bin_order as integer) as bin_order,
 round(avg(current_dep_delayed_15), 6) as delay_rate, cast(count(*) as bigint) as n_obs
from (select {_BIN} as prev_delay_bin, {_BIN_IDX} as bin_order, current_dep_delayed_15 from mf) t
where prev_delay_bin is not null group by prev_delay_bin, bin_order"""


def delay_rate_by_bin(mf: DataFrame) -> DataFrame:
    return R.delay_rate_by_bin(mf).withColumn("delay_rate", r6(F.col("delay_rate")))


query("delay_rate_by_bin", W_FL_MF + DELAY_RATE_SQL)(
    lambda spark, sf: delay_rate_by_bin(mf_of(spark, sf, "flights")))
query("delay_rate_by_bin_multi_year", W_LI_MF + DELAY_RATE_SQL)(
    lambda spark, sf: delay_rate_by_bin(mf_of(spark, sf, "lineitem")))


# ---------------------------------------------------------------- decay
from knockon.operators import decay as D  # noqa: E402


def legs_sql(fx="flights", k=5, upto="clean") -> str:
    idl = ", ".join(ids(fx))
    leads = ", ".join(f"lead(DEP_DELAY, {i}) over w as next_dep_delay_{i}" for i in range(1, k + 1))
    return (cte_chain(fx, upto).rstrip() + f""",
legs as (select {idl}, TAIL_NUM, ARR_DELAY, DEP_DELAY, {leads} from clean
 window w as (partition by TAIL_NUM order by sched_dep_timestamp asc nulls last, {idl})),
shock as (select * from legs where ARR_DELAY > 15),
long as (select TAIL_NUM, k as leg_index,
  case k """ + " ".join(f"when {i} then next_dep_delay_{i}" for i in range(1, k + 1)) + """ end as v
  from shock cross join range(1, """ + str(k + 1) + """) r(k)),
tls as (select TAIL_NUM, cast(leg_index as integer) as leg_index, cast(count(*) as bigint) as n_obs,
  avg(v) as mean_remaining_delay, median(v) as median_remaining_delay
  from long where v is not null group by TAIL_NUM, leg_index),
wm_h as (select leg_index, median_remaining_delay as v, sum(n_obs) as w from tls group by 1, 2),
wm_c as (select *, sum(w) over (partition by leg_index order by v
   rows between unbounded preceding and current row) as cum,
  sum(w) over (partition by leg_index) as tot from wm_h),
wm as (select leg_index, min(v) as median_remaining_delay from wm_c where cum >= tot * 0.5
  group by leg_index),
dbl as (select t.leg_index, cast(sum(n_obs) as bigint) as n_obs,
  sum(n_obs * mean_remaining_delay) / sum(n_obs) as mean_remaining_delay,
  any_value(wm.median_remaining_delay) as median_remaining_delay
  from tls t join wm on t.leg_index = wm.leg_index group by t.leg_index)
""")


def legs_of(spark, sf, fx="flights"):
    return D.later_legs(stage_of(spark, sf, fx), tiebreak=ids(fx))


def tls_of(spark, sf, fx="flights"):
    return D.tail_leg_summary(stage_of(spark, sf, fx), tiebreak=ids(fx))


LEG_COLS = [f"next_dep_delay_{i}" for i in range(1, 6)]
query("later_legs", legs_sql() + "select event_id, " + ", ".join(LEG_COLS) + " from legs")(
    lambda spark, sf: legs_of(spark, sf).select("event_id", *LEG_COLS))
query("later_legs_multi_year", legs_sql("lineitem") + "select " + ", ".join(FX.FX_LINEITEM_ORDER)
      + ", " + ", ".join(LEG_COLS) + " from legs")(
    lambda spark, sf: legs_of(spark, sf, "lineitem").select(*FX.FX_LINEITEM_ORDER, *LEG_COLS))
query("shock_filter", legs_sql() + "select event_id, ARR_DELAY, next_dep_delay_1 from shock")(
    lambda spark, sf: D.shock_rows(legs_of(spark, sf)).select("event_id", "ARR_DELAY",
                                                              "next_dep_delay_1"))
query("tail_leg_summary", legs_sql() + """
select TAIL_NUM, leg_index, n_obs, round(mean_remaining_delay, 6) as mean_remaining_delay,
 round(median_remaining_delay, 6) as median_remaining_delay from tls""")(
    lambda spark, sf: tls_of(spark, sf).select(
        "TAIL_NUM", "leg_index", "n_obs", r6(F.col("mean_remaining_delay")).alias("mean_remaining_delay"),
        r6(F.col("median_remaining_delay")).alias("median_remaining_delay")))
query("weighted_median", legs_sql() + "select leg_index, median_remaining_delay from wm")(
    lambda spark, sf: D.weighted_median(tls_of(spark, sf), ["leg_index"], "median_remaining_delay",
                                        "n_obs", out="median_remaining_delay"))


@query("cumulative_weight", legs_sql() + """
select leg_index, v as median_remaining_delay, cast(w as bigint) as weight, cast(cum as bigint) as cum_weight
from wm_c""")
def q_cumulative_weight(spark, sf):
    from pyspark.sql import Window
    t = tls_of(spark, sf).groupBy("leg_index", "median_remaining_delay").agg(
        F.sum("n_obs").alias("weight"))
    w = Window.partitionBy("leg_index").orderBy("median_remaining_delay").rowsBetween(
        Window.unboundedPreceding, 0)
    return t.withColumn("cum_weight", F.sum("weight").over(w))


query("decay_by_leg", legs_sql() + """
select leg_index, n_obs, round(mean_remaining_delay, 6) as mean_remaining_delay,
 round(median_remaining_delay, 6) as median_remaining_delay from dbl""")(
    lambda spark, sf: D.decay_by_leg(tls_of(spark, sf)).select(
        "leg_index", "n_obs", r6(F.col("mean_remaining_delay")).alias("mean_remaining_delay"),
        r6(F.col("median_remaining_delay")).alias("median_remaining_delay")))

# The fit's score equation has one sign change, so SQL finds lambda by bisection over the few points of
# a curve: 100 halvings of [0, 64] over lists.
def fit_sql(points: str, by: str = "grp") -> str:
    """CTE ``fitted`` (by, amplitude_A, lambda) of the curves in ``points`` (by, leg_index, mean_remaining_delay)."""
    def falls(lam):
        return (f"list_sum(list_transform(range(1, len(ks) + 1), lambda i: ys[i] * exp(-{lam} * (ks[i] - ks[1]))))"
                f" * list_sum(list_transform(range(1, len(ks) + 1), lambda i: (ks[i] - ks[1]) * exp(-2 * {lam} * (ks[i] - ks[1]))))"
                f" > list_sum(list_transform(range(1, len(ks) + 1), lambda i: exp(-2 * {lam} * (ks[i] - ks[1]))))"
                f" * list_sum(list_transform(range(1, len(ks) + 1), lambda i: (ks[i] - ks[1]) * ys[i] * exp(-{lam} * (ks[i] - ks[1]))))")
    return f"""curves as (select {by}, list(cast(leg_index as double) order by leg_index) as ks,
  list(mean_remaining_delay order by leg_index) as ys from {points}
  where mean_remaining_delay > 0 group by {by}),
halved as (select {by}, ks, ys, 0 as step, cast(0 as double) as low,
   case when len(ks) > 1 and {falls('0.0')} then cast(64 as double) else 0 end as high from curves
  union all
  select {by}, ks, ys, step + 1,
   case when {falls('((low + high) / 2)')} then (low + high) / 2 else low end,
   case when {falls('((low + high) / 2)')} then high else (low + high) / 2 end
  from halved where step < 100),
fitted as (select {by}, case when len(ks) > 1 then (low + high) / 2 end as lam,
  case when len(ks) > 1 then list_sum(list_transform(range(1, len(ks) + 1), lambda i: ys[i] * exp(-low * ks[i])))
    / list_sum(list_transform(range(1, len(ks) + 1), lambda i: exp(-2 * low * ks[i]))) end as amplitude_A
  from halved where step = 100)"""


def recursive(sql: str) -> str:
    """The same query with a recursive WITH."""
    return re.sub(r"^\s*with\b", "with recursive", sql, count=1)


ONE_CURVE = recursive(legs_sql().rstrip() + ", one as (select 1 as grp, * from dbl), " + fit_sql("one"))
PER_CARRIER = recursive(legs_sql().replace(
    "legs as (select event_id, TAIL_NUM, ARR_DELAY, DEP_DELAY,",
    "legs as (select event_id, TAIL_NUM, OP_UNIQUE_CARRIER, ARR_DELAY, DEP_DELAY,").rstrip() + """,
lc as (select OP_UNIQUE_CARRIER, k as leg_index,
  case k """ + " ".join(f"when {i} then next_dep_delay_{i}" for i in range(1, 6)) + """ end as v
  from shock cross join range(1, 6) r(k)),
lcm as (select OP_UNIQUE_CARRIER, leg_index, avg(v) as mean_remaining_delay from lc where v is not null
  group by OP_UNIQUE_CARRIER, leg_index), """ + fit_sql("lcm", "OP_UNIQUE_CARRIER"))
A_LAMBDA = 'round(amplitude_A, 5) as amplitude_A, round(lam, 6) as "lambda"'


def a_lambda(df: DataFrame, *keep) -> DataFrame:
    return df.select(*keep, F.round(D.nan_to_null("amplitude_A"), 5).alias("amplitude_A"),
                     r6(D.nan_to_null("lambda")).alias("lambda"))


query("decay_fit", ONE_CURVE + f" select {A_LAMBDA} from fitted")(
    lambda spark, sf: a_lambda(D.fit_groups(D.decay_by_leg(tls_of(spark, sf)), [])))
query("decay_parameters", ONE_CURVE + f""" select {A_LAMBDA},
 case when lam > 0 then round(ln(2) / lam, 5) end as half_life_legs, cast(15 as double) as shock_threshold,
 5 as max_leg, 'future_departure_delay' as delay_measure from fitted""")(
    lambda spark, sf: a_lambda(D.decay_parameters(D.decay_by_leg(tls_of(spark, sf))), F.round(
        "half_life_legs", 5).alias("half_life_legs"), "shock_threshold", "max_leg", "delay_measure"))
query("decay_table", ONE_CURVE + """ select leg_index, n_obs, round(mean_remaining_delay, 6) as mean_remaining_delay,
 round(median_remaining_delay, 6) as median_remaining_delay,
 round(amplitude_A * exp(-lam * leg_index), 5) as fitted_decay_value from dbl, fitted""")(
    lambda spark, sf: D.decay_table(D.decay_by_leg(tls_of(spark, sf))).select(
        "leg_index", "n_obs", r6(F.col("mean_remaining_delay")).alias("mean_remaining_delay"),
        r6(F.col("median_remaining_delay")).alias("median_remaining_delay"),
        F.round("fitted_decay_value", 5).alias("fitted_decay_value")))
query("decay_fit_by_carrier", PER_CARRIER + f" select OP_UNIQUE_CARRIER, {A_LAMBDA} from fitted")(
    lambda spark, sf: a_lambda(D.fit_groups(
        D.decay_by_leg_by(stage_of(spark, sf), ["OP_UNIQUE_CARRIER"], tiebreak=ids()),
        ["OP_UNIQUE_CARRIER"]), "OP_UNIQUE_CARRIER"))


# ---------------------------------------------------------------- features and simple aggregates
MF_OUT = [*FX.FX_LINEITEM_ORDER, "current_year", "current_month", "current_day_of_week",
          "turnaround_bin", "dep_period"]
query("calendar_features", W_LI_MF + "select " + ", ".join(MF_OUT[:-2]) + " from mf0")(
    lambda spark, sf: FE.add_features(pairs_of(spark, sf, "lineitem"), keep=ids("lineitem")).select(
        *MF_OUT[:-2]))
query("dep_period", W_LI_MF + "select " + ", ".join(FX.FX_LINEITEM_ORDER)
      + ", current_sched_dep_hour, dep_period from mf0")(
    lambda spark, sf: FE.add_features(pairs_of(spark, sf, "lineitem"), keep=ids("lineitem")).select(
        *FX.FX_LINEITEM_ORDER, "current_sched_dep_hour", "dep_period"))
query("turnaround_bin", W_LI_MF + "select " + ", ".join(FX.FX_LINEITEM_ORDER)
      + ", scheduled_turnaround_minutes, turnaround_bin from mf0")(
    lambda spark, sf: FE.add_features(pairs_of(spark, sf, "lineitem"), keep=ids("lineitem")).select(
        *FX.FX_LINEITEM_ORDER, "scheduled_turnaround_minutes", "turnaround_bin"))


@query("prev_delay_bin", W_LI_MF + f"""
select {", ".join(FX.FX_LINEITEM_ORDER)}, prev_ARR_DELAY, {_BIN} as prev_delay_bin from mf""")
def q_prev_delay_bin(spark, sf):
    return mf_of(spark, sf).select(*FX.FX_LINEITEM_ORDER, "prev_ARR_DELAY",
                                   X.prev_delay_bin("prev_ARR_DELAY").alias("prev_delay_bin"))


query("complete_cases", W_LI_MF + "select " + ", ".join(FX.FX_LINEITEM_ORDER) + " from mf")(
    lambda spark, sf: mf_of(spark, sf).select(*FX.FX_LINEITEM_ORDER))


@query("year_window", W_LI_P + """
select cast(year(current_FL_DATE) as integer) as current_year, cast(count(*) as bigint) as n_pairs
from pairs where year(current_FL_DATE) between 1994 and 1996 group by 1""")
def q_year_window(spark, sf):
    p = FE.year_window(pairs_of(spark, sf, "lineitem"), 1994, 1996)
    return p.groupBy(F.year("current_FL_DATE").cast("int").alias("current_year")).agg(
        F.count(F.lit(1)).alias("n_pairs"))


query("target_means", W_LI_MF + """
select cast(count(*) as bigint) as n_obs, round(avg(current_DEP_DELAY), 6) as mean_dep_delay,
 round(avg(current_dep_delayed_15), 6) as delay_rate_gt15 from mf""")(
    lambda spark, sf: mf_of(spark, sf).agg(
        F.count(F.lit(1)).alias("n_obs"), r6(F.avg("current_DEP_DELAY")).alias("mean_dep_delay"),
        r6(F.avg("current_dep_delayed_15")).alias("delay_rate_gt15")))

query("pairs_by_year", W_LI_MF + """
select current_year as year, cast(count(*) as bigint) as n_modeling_pairs,
 round(count(*) / 1000000.0, 6) as pairs_million from mf group by current_year""")(
    lambda spark, sf: mf_of(spark, sf).groupBy(F.col("current_year").alias("year")).agg(
        F.count(F.lit(1)).alias("n_modeling_pairs"),
        r6(F.count(F.lit(1)) / F.lit(1e6)).alias("pairs_million")))

query("year_effect_check", W_LI_MF + """
select cast(count(distinct current_year) as bigint) as n_years,
 count(distinct current_year) > 1 as include_year_effect from mf""")(
    lambda spark, sf: mf_of(spark, sf).agg(F.count_distinct("current_year").alias("n_years")).withColumn(
        "include_year_effect", F.col("n_years") > 1))

query("quantile_range", W_LI_MF + """
select round(quantile_cont(prev_ARR_DELAY, 0.01), 6) as q01, round(quantile_cont(prev_ARR_DELAY, 0.99), 6) as q99
from mf""")(lambda spark, sf: R.quantile_range(
    mf_of(spark, sf), "prev_ARR_DELAY").select(r6(F.col("q_lo")).alias("q01"), r6(F.col("q_hi")).alias("q99")))

QUANTILES = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


# net prices are nearly all distinct, so a map of values would hold the whole table
@query("exact_quantiles", " union all ".join(
    f"select cast({p} as double) as prob, round(quantile_cont(l_extendedprice * (1 - l_discount), {p}), 6) as net_price "
    "from lineitem" for p in QUANTILES))
def q_exact_quantiles(spark, sf):
    net = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"))
    rows = spark.createDataFrame(list(zip(QUANTILES, exact_quantiles(net, "net_price", QUANTILES))),
                                 "prob double, net_price double")
    return rows.select("prob", r6(F.col("net_price")).alias("net_price"))



@query("group_n_obs", W_LI_MF + """
select 'airline' as grouping, OP_UNIQUE_CARRIER as level, cast(count(*) as bigint) as n_obs
from mf group by OP_UNIQUE_CARRIER
union all
select 'turnaround_bin', l.label, cast(count(mf.turnaround_bin) as bigint)
from (values ('20-44'), ('45-89'), ('90-179'), ('180-600')) l(label)
left join mf on mf.turnaround_bin = l.label group by l.label""")
def q_group_n_obs(spark, sf):
    mf = mf_of(spark, sf)
    air = mf.groupBy(F.lit("airline").alias("grouping"),
                     F.col("OP_UNIQUE_CARRIER").alias("level")).agg(F.count(F.lit(1)).alias("n_obs"))
    labels = spark.createDataFrame([(lv,) for lv in C.S.TURNAROUND_LABELS], "level string")
    turn = (mf.groupBy(F.col("turnaround_bin").alias("level")).agg(F.count(F.lit(1)).alias("n"))
            .join(F.broadcast(labels), "level", "right")
            .select(F.lit("turnaround_bin").alias("grouping"), "level",
                    F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n_obs")))
    return air.unionByName(turn)


@query("dataset_totals", cte_chain("lineitem", "pairs") + """
select (select cast(count(*) as bigint) from clean) as total_cleaned_flights,
 (select cast(count(*) as bigint) from pairs) as total_flight_pairs,
 (select cast(count(distinct strftime(FL_DATE, '%Y-%m')) as bigint) from clean) as total_months_used""")
def q_dataset_totals(spark, sf):
    from knockon.operators import reports as R
    clean = pair_stage_of(spark, sf, "lineitem")
    return R.dataset_totals(clean, P.flight_pairs(clean, tiebreak=ids("lineitem")))


@query("sample_pairs", W_LI_MF + """
select """ + ", ".join(FX.FX_LINEITEM_ORDER) + """, prev_ARR_DELAY, current_DEP_DELAY from mf
order by md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, cast(l_extendedprice as decimal(18,2)), '42'))
limit 50000""")
def q_sample_pairs(spark, sf):
    from knockon.operators import reports as R
    keys = [*FX.FX_LINEITEM_ORDER[:3], F.col("l_extendedprice").cast("decimal(18,2)")]
    return R.sample_rows(mf_of(spark, sf), keys, 50_000, 42).select(
        *FX.FX_LINEITEM_ORDER, "prev_ARR_DELAY", "current_DEP_DELAY")


_SAMPLE_KEYS = [*FX.FX_LINEITEM_ORDER[:3], "l_extendedprice"]


@query("sample_pairs_small", W_LI_MF + """
select """ + ", ".join(FX.FX_LINEITEM_ORDER) + """ from mf
order by md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, cast(l_extendedprice as decimal(18,2)), '42'))
limit 1000""")
def q_sample_pairs_small(spark, sf):
    """A sample far below the row count."""
    keys = [*_SAMPLE_KEYS[:3], F.col("l_extendedprice").cast("decimal(18,2)")]
    return R.sample_rows(materialize(mf_of(spark, sf), "mf"), keys, 1000, 42).select(*FX.FX_LINEITEM_ORDER)


query("union_inputs", W_LI_P + """
select cast(year(current_FL_DATE) as integer) as current_year, cast(count(*) as bigint) as n_pairs
from (select * from pairs where year(current_FL_DATE) < 1996
      union all select * from pairs where year(current_FL_DATE) >= 1996) u group by 1""")(
    lambda spark, sf: (lambda p: FE.year_window(p, None, 1995).unionByName(FE.year_window(p, 1996, None)))(
        pairs_of(spark, sf, "lineitem")).groupBy(F.year("current_FL_DATE").cast("int").alias(
            "current_year")).agg(F.count(F.lit(1)).alias("n_pairs")))


# ---------------------------------------------------------------- fits with closed forms
# The library's own fits on designs whose solution SQL can state: one regressor for the linear model, and a
# 0/1 regressor for the logit, where a cell's log odds ratio is the slope and the cell rates are the scores.
from knockon.operators import grouped as G  # noqa: E402
from knockon.operators import models as M  # noqa: E402
from knockon.plans import suite as SU  # noqa: E402

def single() -> M.Design:
    """The previous delay alone."""
    return M.build_design({}, [], [])


_SLOPE_SQL = """count(*) as n, regr_slope(current_DEP_DELAY, prev_ARR_DELAY) as b,
 regr_intercept(current_DEP_DELAY, prev_ARR_DELAY) as a, regr_r2(current_DEP_DELAY, prev_ARR_DELAY) as r2,
 sqrt((regr_syy(current_DEP_DELAY, prev_ARR_DELAY) - regr_slope(current_DEP_DELAY, prev_ARR_DELAY)
       * regr_sxy(current_DEP_DELAY, prev_ARR_DELAY)) / (count(*) - 2)
      / regr_sxx(current_DEP_DELAY, prev_ARR_DELAY)) as se"""
_LINE = "round(a, 6) as intercept, round(b, 6) as slope, round(se, 6) as std_err, round(r2, 6) as r_squared"
LINES = "intercept double, slope double, std_err double, r_squared double"


def _line(b, se, r2):
    return tuple(round(float(x), 6) for x in (b[0], b[1], se[1], r2))


@query("ols_single_regressor", W_LI_MF + f" select {_LINE} from (select {_SLOPE_SQL} from mf) t")
def q_ols_single(spark, sf):
    fit = G.fit_ols(mf_of(spark, sf), single())
    return spark.createDataFrame([_line(fit.estimates, fit.std_errs, fit.metrics["r_squared"])], LINES)


def lines_by(spark, mf, by, key):
    """One regressor per group, all groups in one pass of the grouped fit."""
    fits = G.grouped_ols(mf, by, single())
    return spark.createDataFrame([(g, int(v["n"]), *_line(v["beta"], v["se"], v["r2"])) for g, v in sorted(fits.items())],
                                 f"{key} string, n_obs long, {LINES}")


@query("slope_by_year", W_LI_MF + f"""
select cast(current_year as varchar) as year, cast(n as bigint) as n_obs, {_LINE}
from (select current_year, {_SLOPE_SQL} from mf group by current_year) t""")
def q_slope_by_year(spark, sf):
    return lines_by(spark, materialize(mf_of(spark, sf), "mf"), "current_year", "year")


def binary_of(spark, sf) -> DataFrame:
    """The model frame with the previous delay as a 0/1 flag (late by more than 15 minutes)."""
    return mf_of(spark, sf).withColumn(M.PREV, (F.col(M.PREV) > 15).cast("double"))


def cells_sql(by: str | None = None) -> str:
    """CTEs on the binary frame: ``cell`` counts and ``odds`` (log odds ratio ``g`` and its error ``se``) per ``grp``."""
    grp = by or "'all'"
    return W_LI_MF.rstrip() + f""",
bin as (select {grp} as grp, cast(prev_ARR_DELAY > 15 as integer) as x, current_dep_delayed_15 as y,
  current_DEP_DELAY as d from mf),
cell as (select grp, cast(count(*) as double) as n, cast(sum(x * y) as double) as n11,
  cast(sum(x * (1 - y)) as double) as n10, cast(sum((1 - x) * y) as double) as n01,
  cast(sum((1 - x) * (1 - y)) as double) as n00, regr_slope(d, x) as lb, regr_intercept(d, x) as la,
  regr_r2(d, x) as lr2, avg(d) as mean_d,
  sqrt((regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x)) / (count(*) - 2) / regr_sxx(d, x)) as lse
  from bin group by grp),
odds as (select *, ln(n11 * n00 / (n10 * n01)) as g, ln(n01 / n00) as g0,
  sqrt(1 / n11 + 1 / n10 + 1 / n01 + 1 / n00) as se, sqrt(1 / n01 + 1 / n00) as se0,
  (n11 * n00 + (n11 * n10 + n01 * n00) / 2) / ((n11 + n01) * (n10 + n00)) as auc,
  (n11 * n11 / (n11 + n10) + n01 * (n11 + n01) / n) / (n11 + n01) as ap,
  -2 * (n11 * ln(n11 / (n11 + n10)) + n10 * ln(n10 / (n11 + n10)) + n01 * ln(n01 / (n01 + n00))
        + n00 * ln(n00 / (n01 + n00))) as dev,
  -2 * ((n11 + n01) * ln((n11 + n01) / n) + (n10 + n00) * ln((n10 + n00) / n)) as dev0 from cell)
"""


Z = repr(M.Z975)
# Student's t quantile by the same expansion as the fits use
_T = (f"({Z} + {(M.Z975 ** 3 + M.Z975) / 4!r} / (n - 2) + {(5 * M.Z975 ** 5 + 16 * M.Z975 ** 3 + 3 * M.Z975) / 96!r} / (n - 2) ** 2"
      f" + {(3 * M.Z975 ** 7 + 19 * M.Z975 ** 5 + 17 * M.Z975 ** 3 - 15 * M.Z975) / 384!r} / (n - 2) ** 3"
      f" + {(79 * M.Z975 ** 9 + 776 * M.Z975 ** 7 + 1482 * M.Z975 ** 5 - 1920 * M.Z975 ** 3 - 945 * M.Z975) / 92160!r} / (n - 2) ** 4)")


def binary_suite(spark, sf, *models) -> dict:
    return SU.fit_suite(spark, binary_of(spark, sf), models=models, factors=[], numerics=[])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; other columns as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


query("coefficients_binary", cells_sql() + f""", est as (
 select 'linear' as model, 'prev_ARR_DELAY' as term, lb as estimate, lse as std_err, {_T} as mult from odds
 union all select 'logistic', 'Intercept', g0, se0, {Z} from odds
 union all select 'logistic', 'prev_ARR_DELAY', g, se, {Z} from odds)
select model, term, round(estimate, 5) as estimate, round(std_err, 5) as std_err,
 round(estimate - mult * std_err, 5) as ci_lower, round(estimate + mult * std_err, 5) as ci_upper,
 case when model = 'logistic' then round(exp(estimate), 5) end as odds_ratio from est""")(
    lambda spark, sf: rounded(binary_suite(spark, sf, "linear", "logistic")["coefficients"].where(
        "model = 'logistic' or term = 'prev_ARR_DELAY'").select(
        "model", "term", "estimate", "std_err", "ci_lower", "ci_upper", "odds_ratio"), 5))

query("metrics_binary", cells_sql() + """
select 'linear' as model, n as n_obs, round(lr2, 6) as r_squared, null::double as deviance,
 null::double as null_deviance, null::double as aic, null::double as roc_auc, null::double as average_precision,
 round(mean_d, 6) as mean_target from odds
union all select 'logistic', n, null, round(dev, 4), round(dev0, 4), round(dev + 4, 4), round(auc, 6), round(ap, 6),
 round((n11 + n01) / n, 6) from odds""")(
    lambda spark, sf: binary_suite(spark, sf, "linear", "logistic")["metrics"].select(
        "model", "n_obs", r6(F.col("r_squared")).alias("r_squared"), F.round("deviance", 4).alias("deviance"),
        F.round("null_deviance", 4).alias("null_deviance"),
        F.round(F.when(F.col("model") == "logistic", F.col("aic")), 4).alias("aic"),
        r6(F.col("roc_auc")).alias("roc_auc"), r6(F.col("average_precision")).alias("average_precision"),
        r6(F.col("mean_target")).alias("mean_target")))

_MAIN_SQL = f"""select cast(n as bigint) as n_modeling_pairs, round(g, 5) as logistic_prev_arr_delay_coef,
 round(g - {Z} * se, 5) as logistic_ci_lower, round(g + {Z} * se, 5) as logistic_ci_upper,
 round(exp(g), 5) as logistic_odds_ratio_per_1_min, round(g * 10, 4) as ln_or10,
 round(lb, 5) as linear_prev_arr_delay_coef, round(lb - {_T} * lse, 5) as linear_ci_lower,
 round(lb + {_T} * lse, 5) as linear_ci_upper, round(10 * lb, 5) as minutes_carried_per_10_min_prev_delay from odds"""
query("main_result_binary", cells_sql() + _MAIN_SQL)(
    lambda spark, sf: rounded(binary_suite(spark, sf, "linear", "logistic")["main_result"].withColumn(
        "ln_or10", F.round(F.log("logistic_odds_ratio_per_10_min"), 4)).drop(
        "logistic_odds_ratio_per_10_min", "logistic_or10_ci_lower", "logistic_or10_ci_upper"), 5))

query("secondary_result_binary", cells_sql() + f"""
select round(lb, 5) as linear_prev_arr_delay_coef, round(lb - {_T} * lse, 5) as linear_ci_lower,
 round(lb + {_T} * lse, 5) as linear_ci_upper, round(10 * lb, 5) as minutes_carried_per_10_min_prev_delay from odds""")(
    lambda spark, sf: rounded(binary_suite(spark, sf, "linear", "logistic")["secondary_result"], 5))

query("presentation_metrics_binary", cells_sql() + """, wide as (
 select n, 10 * lb as m, 10 * g as ln_or, auc, ap, lr2 from odds)
select 'n_modeling_pairs' as metric, round(n, 5) as value from wide
union all select 'linear_minutes_carried_per_10_min_prev_delay', round(m, 5) from wide
union all select 'logistic_odds_ratio_per_10_min_prev_delay', round(ln_or, 5) from wide
union all select 'logistic_roc_auc', round(auc, 5) from wide
union all select 'logistic_average_precision', round(ap, 5) from wide
union all select 'linear_r_squared', round(lr2, 5) from wide""")(
    lambda spark, sf: (lambda out: R.presentation_metrics(spark, out["main_result"], out["metrics"]).select(
        "metric", F.round(F.when(F.col("metric").contains("odds_ratio"), F.log("value")).otherwise(F.col("value")), 5)
        .alias("value")))(binary_suite(spark, sf, "linear", "logistic")))

query("predict_scores_binary", cells_sql() + """
select round(case when x = 1 then n11 / (n11 + n10) else n01 / (n01 + n00) end, 6) as probability,
 cast(y as double) as label, cast(count(*) as bigint) as n from bin, odds group by all""")(
    lambda spark, sf: binary_suite(spark, sf, "logistic")["predict_scores"].groupBy(
        F.round("prediction", 6).alias("probability"), "label").agg(F.count(F.lit(1)).alias("n")))

_LEVELS_SQL = f"""round(g, 5) as carryover_log_odds_per_1_min, round(se, 5) as std_err,
 round(g - 1.96 * se, 5) as ci_lower, round(g + 1.96 * se, 5) as ci_upper, cast(n as bigint) as n_obs from odds"""


def _levels(table: DataFrame, key: str) -> DataFrame:
    return rounded(table.select(key, "carryover_log_odds_per_1_min", "std_err", "ci_lower", "ci_upper", "n_obs"), 5)


query("airline_carryover_binary", cells_sql("OP_UNIQUE_CARRIER") + f" select grp as airline, {_LEVELS_SQL}")(
    lambda spark, sf: _levels(binary_suite(spark, sf, "airline")["airline_carryover"], "airline"))
query("turnaround_carryover_binary", cells_sql("turnaround_bin") + f" select grp as turnaround_bin, {_LEVELS_SQL}")(
    lambda spark, sf: _levels(binary_suite(spark, sf, "turnaround")["turnaround_carryover"], "turnaround_bin"))

# the treatment-coded terms behind those slopes: the base level's slope, and each other level's difference from it
_TERMS_SQL = """, base as (select * from odds order by {order} limit 1)
select 'prev_ARR_DELAY' as term, round(g, 5) as estimate, round(se, 5) as std_err from base
union all select 'prev_ARR_DELAY:C({by})[T.' || o.grp || ']', round(o.g - b.g, 5), round(sqrt(o.se * o.se + b.se * b.se), 5)
 from odds o, base b where o.grp <> b.grp"""


def _terms(out: dict) -> DataFrame:
    return rounded(out["coefficients"].where(F.col("term").startswith("prev_ARR_DELAY")).select(
        "term", "estimate", "std_err"), 5)


query("logit_airline_binary", cells_sql("OP_UNIQUE_CARRIER") + _TERMS_SQL.format(by="OP_UNIQUE_CARRIER", order="grp"))(
    lambda spark, sf: _terms(binary_suite(spark, sf, "airline")))
query("logit_turnaround_binary", cells_sql("turnaround_bin") + _TERMS_SQL.format(
    by="turnaround_bin", order="cast(split_part(grp, '-', 1) as integer)"))(
    lambda spark, sf: _terms(binary_suite(spark, sf, "turnaround")))


def periods_binary(spark, sf, periods) -> DataFrame:
    mf = materialize(binary_of(spark, sf), "mf")
    return SU.fit_periods(spark, mf, periods(SU.years_of(mf)), factors=[], numerics=[])


_PERIOD_SQL = """round(lb, 5) as linear_coef, round(10 * lb, 5) as minutes_carried_per_10_min,
 round(lr2, 5) as linear_r_squared, round(g, 5) as logistic_coef, round(auc, 5) as logistic_auc,
 round(ap, 5) as logistic_average_precision, round((n11 + n01) / n, 5) as current_delay_rate_gt15 from odds"""
_PERIOD_COLS = ["linear_coef", "minutes_carried_per_10_min", "linear_r_squared", "logistic_coef", "logistic_auc",
                "logistic_average_precision", "current_delay_rate_gt15"]
query("fit_by_year_binary", cells_sql("cast(current_year as varchar)") + f"""
 select grp as period, 'ok' as status, cast(n as bigint) as n_modeling_pairs, {_PERIOD_SQL}""")(
    lambda spark, sf: rounded(periods_binary(spark, sf, SU.yearly_periods).select(
        "period", "status", "n_modeling_pairs", *_PERIOD_COLS), 5))
_WINDOW = "cast(current_year - (current_year - (select min(current_year) from mf)) % 3 as integer)"
query("fit_by_window_binary", cells_sql(_WINDOW) + f"""
 select grp as start_year, 'ok' as status, cast(n as bigint) as n_modeling_pairs, {_PERIOD_SQL}""")(
    lambda spark, sf: rounded(periods_binary(spark, sf, SU.window_periods).select(
        "start_year", "status", "n_modeling_pairs", *_PERIOD_COLS), 5))
query("yearly_summary_binary", cells_sql("current_year") + f"""
 select grp as year, cast(n as bigint) as n_modeling_pairs, round(10 * g, 4) as ln_or10,
 round(10 * (g - {Z} * se), 4) as ln_or10_ci_lower, round(10 * (g + {Z} * se), 4) as ln_or10_ci_upper,
 round(10 * lb, 4) as minutes_carried_per_10min from odds""")(
    lambda spark, sf: rounded(R.yearly_summary(periods_binary(spark, sf, SU.yearly_periods)).select(
        "year", "n_modeling_pairs", F.log("logistic_or_per_10min").alias("ln_or10"),
        F.log("logistic_or10_ci_lower").alias("ln_or10_ci_lower"),
        F.log("logistic_or10_ci_upper").alias("ln_or10_ci_upper"), "minutes_carried_per_10min"), 4))


from knockon.operators import metrics as ME  # noqa: E402

CURVE_SQL = W_LI_MF + """,
g as (select cast(prev_ARR_DELAY as double) as score, cast(sum(current_dep_delayed_15) as bigint) as tp,
  cast(sum(1 - current_dep_delayed_15) as bigint) as fp from mf group by 1),
c as (select *, sum(tp) over (order by score desc rows between unbounded preceding and current row) as cum_tp,
  sum(fp) over (order by score desc rows between unbounded preceding and current row) as cum_fp from g)
""".replace("\n,\n", ",\n")


def _curve_sql(tail):
    return CURVE_SQL + tail


query("score_curve", _curve_sql("select score, tp, fp, cast(cum_tp as bigint) as cum_tp, "
                                "cast(cum_fp as bigint) as cum_fp from c"))(
    lambda spark, sf: ME.score_curve(mf_of(spark, sf), "prev_ARR_DELAY", "current_dep_delayed_15"))

query("ranking_metrics_prev_delay", _curve_sql("""select
 round(sum((cum_fp - (cum_fp - fp)) * (cum_tp + (cum_tp - tp)) / 2.0) / (sum(tp) * sum(fp)), 6) as roc_auc,
 round(sum(tp * (cum_tp * 1.0 / (cum_tp + cum_fp))) / sum(tp), 6) as average_precision from c"""))(
    lambda spark, sf: ME.ranking_metrics(mf_of(spark, sf), "prev_ARR_DELAY", "current_dep_delayed_15")
    .select(r6(F.col("roc_auc")).alias("roc_auc"), r6(F.col("average_precision")).alias("average_precision")))


# ---------------------------------------------------------------- density grid (hexagonal bins)
from knockon.operators import reports as R  # noqa: E402


def _hex_sql(gridsize=45):
    import math as _m
    ny = int(gridsize / _m.sqrt(3))
    return W_LI_MF + f""",
bnd as (select min(prev_ARR_DELAY) as x0r, max(prev_ARR_DELAY) as x1r, min(current_DEP_DELAY) as y0,
  max(current_DEP_DELAY) as y1 from mf),
b2 as (select x0r - 1e-9 * (x1r - x0r) as x0, x1r + 1e-9 * (x1r - x0r) as x1, y0, y1 from bnd),
b3 as (select x0, y0, (x1 - x0) / {gridsize} as sx, (y1 - y0) / {ny} as sy from b2),
p as (select (prev_ARR_DELAY - x0) / sx as ix, (current_DEP_DELAY - y0) / sy as iy, x0, y0, sx, sy
  from mf, b3),
q as (select *, cast(round_even(ix, 0) as integer) as ix1, cast(round_even(iy, 0) as integer) as iy1,
  cast(floor(ix) as integer) as ix2, cast(floor(iy) as integer) as iy2 from p),
r as (select *, (ix - ix1) * (ix - ix1) + 3.0 * (iy - iy1) * (iy - iy1)
   < (ix - ix2 - 0.5) * (ix - ix2 - 0.5) + 3.0 * (iy - iy2 - 0.5) * (iy - iy2 - 0.5) as first from q),
s as (select case when first then 1 else 2 end as lattice,
  case when first then ix1 else ix2 end as i, case when first then iy1 else iy2 end as j,
  case when first then ix1 between 0 and {gridsize} and iy1 between 0 and {ny}
       else ix2 between 0 and {gridsize - 1} and iy2 between 0 and {ny - 1} end as inside,
  x0, y0, sx, sy from r)
select lattice, i, j,
 round(any_value(x0) + (i + case when lattice = 2 then 0.5 else 0.0 end) * any_value(sx), 6) as center_x,
 round(any_value(y0) + (j + case when lattice = 2 then 0.5 else 0.0 end) * any_value(sy), 6) as center_y,
 cast(count(*) as bigint) as count
from s where inside group by lattice, i, j"""


@query("density_grid", _hex_sql().replace("\n,\n", ",\n"))
def q_density_grid(spark, sf):
    g = R.density_grid(mf_of(spark, sf), "prev_ARR_DELAY", "current_DEP_DELAY")
    return g.select("lattice", "i", "j", r6(F.col("center_x")).alias("center_x"),
                    r6(F.col("center_y")).alias("center_y"), "count")


_RANK_SQL = f"t as (select OP_UNIQUE_CARRIER as airline, cast(n as bigint) as n_obs, {_LINE} from (select OP_UNIQUE_CARRIER, {_SLOPE_SQL} from mf group by 1) t0)"


def airline_lines(spark, sf):
    return lines_by(spark, materialize(mf_of(spark, sf), "mf"), "OP_UNIQUE_CARRIER", "airline")


query("rank_airlines_linear", W_LI_MF.rstrip() + f", {_RANK_SQL} select * from t order by slope desc, airline limit 10")(
    lambda spark, sf: R.rank_by(airline_lines(spark, sf), "slope", 10, tie="airline"))
query("top_bottom_airlines_linear", W_LI_MF.rstrip() + f""", {_RANK_SQL}
select * from (select *, 'top' as part from t order by slope desc, airline limit 6)
union all select * from (select *, 'bottom' as part from t order by slope, airline limit 6)""")(
    lambda spark, sf: R.top_bottom(airline_lines(spark, sf), "slope", 6, tie="airline"))


# ---------------------------------------------------------------- models with all controls
# The SQL twins solve the same systems: Gauss-Jordan elimination in a recursive CTE, once for the linear model,
# once per step for the logits.  tests/test_models.py also compares the fits with NumPy.
def suite_of(spark, sf, *models, fx="lineitem"):
    return SU.fit_suite(spark, mf_of(spark, sf, fx), models=models or SU.MODELS)


_LEVEL_VALUES = {"OP_UNIQUE_CARRIER": [f"C{i}" for i in range(7)], "current_month": list(range(1, 13)),
                 "current_day_of_week": list(range(1, 8)), "dep_period": C.S.DEP_PERIOD_LABELS,
                 "current_year": list(range(1995, 2002))}


def _safe(term: str) -> str:
    return (term.replace("(", "_").replace(")", "").replace("[", "_").replace("]", "").replace(".", "_")
            .replace("-", "_"))


def _design_sql() -> str:
    """Dummies of the fixture's levels (every one of them occurs at each scale)."""
    cells = ["prev_ARR_DELAY"]
    for f, values in _LEVEL_VALUES.items():
        for v in values[1:]:
            cells.append(f"cast({f} = {v!r} as double) as " + _safe(f"C({f})[T.{v}]"))
    return ", ".join(cells + [f"cast({c} as double) as {c}" for c in M.NUMERIC_CONTROLS])


@query("design_matrix", W_LI_MF + "select " + ", ".join(FX.FX_LINEITEM_ORDER) + ", " + _design_sql() + " from mf")
def q_design_matrix(spark, sf):
    mf = mf_of(spark, sf)
    levels = M.factor_levels(mf, ["OP_UNIQUE_CARRIER", *M.CALENDAR_FACTORS, "current_year"])
    d = M.build_design(levels, M.model_factors(levels), M.NUMERIC_CONTROLS)
    return mf.select(*FX.FX_LINEITEM_ORDER, *[e.alias(_safe(n)) for e, n in zip(d.exprs, d.names)])


def ols_sql() -> str:
    """CTEs of the full linear model: the normal equations, inverted by Gauss-Jordan elimination row by row.

    ``beta`` has a row per term: its place, name, estimate and the diagonal of the inverse; ``fit`` has n, k, rss, tss.
    """
    names, cells = ["Intercept", M.PREV], ["1.0", "prev_ARR_DELAY"]
    for f, values in _LEVEL_VALUES.items():
        for v in values[1:]:
            names.append(f"C({f})[T.{v}]")
            cells.append(f"cast({f} = {v!r} as double)")
    names += M.NUMERIC_CONTROLS
    cells += M.NUMERIC_CONTROLS
    p = len(cells)
    x = ", ".join(f"cast({c} as double) as x{i}" for i, c in enumerate(cells, 1))
    sums = ", ".join([f"sum(x{i} * x{j}) as g{i}_{j}" for i in range(1, p + 1) for j in range(i, p + 1)]
                     + [f"sum(x{i} * y) as b{i}" for i in range(1, p + 1)])
    rows = " union all ".join(
        f"select {i} as i, {names[i - 1]!r} as term, b{i} as moment, [" + ", ".join(
            [f"g{min(i, j)}_{max(i, j)}" for j in range(1, p + 1)] + [f"b{i}"]
            + ["1.0" if i == j else "0.0" for j in range(1, p + 1)]) + "] as cells from gram" for i in range(1, p + 1))
    return recursive(W_LI_MF.rstrip() + f""",
design as (select {x}, cast(current_DEP_DELAY as double) as y from mf),
gram as (select {sums} from design),
system as ({rows}),
solved as (select 0 as step, i, term, moment, cells from system
 union all
 select step + 1, i, term, moment, case when i = step + 1 then list_transform(cells, lambda v: v / cells[step + 1])
  else list_transform(range(1, len(cells) + 1), lambda j: cells[j] - cells[step + 1] * lead_row[j] / lead_row[step + 1]) end
 from (select *, max(case when i = step + 1 then cells end) over () as lead_row from solved where step < {p}) t),
beta as (select i, term, moment, cells[{p + 1}] as estimate, cells[{p + 1} + i] as spread from solved where step = {p}),
fit as (select count(*) as n, {p} as k, sum(y * y) - (select sum(estimate * moment) from beta) as rss,
  sum(y * y) - sum(y) * sum(y) / count(*) as tss, avg(y) as mean_y from design)
""")


def _t_sql(df: str) -> str:
    """Student's t 97.5 % point by the expansion that the fits use."""
    return _T.replace("(n - 2)", f"({df})")


OLS_SQL = ols_sql()


@query("ols_carryover", OLS_SQL + f"""select 'linear' as model, term, round(estimate, 6) as estimate,
 round(sqrt(spread * rss / (n - k)), 6) as std_err,
 round(estimate - {_t_sql('n - k')} * sqrt(spread * rss / (n - k)), 6) as ci_lower,
 round(estimate + {_t_sql('n - k')} * sqrt(spread * rss / (n - k)), 6) as ci_upper from beta, fit""")
def q_ols_carryover(spark, sf):
    return rounded(suite_of(spark, sf, "linear")["coefficients"].select(
        "model", "term", "estimate", "std_err", "ci_lower", "ci_upper"))


query("linear_metrics", OLS_SQL + """select 'linear' as model, cast(n as double) as n_obs, round(1 - rss / tss, 6) as r_squared,
 round(1 - (rss / (n - k)) / (tss / (n - 1)), 6) as adj_r_squared,
 round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * k, 4) as aic,
 round(n * (ln(2 * pi()) + ln(rss / n) + 1) + k * ln(n), 4) as bic, round(mean_y, 6) as mean_target from fit""")(
    lambda spark, sf: suite_of(spark, sf, "linear")["metrics"].select(
        "model", "n_obs", r6(F.col("r_squared")).alias("r_squared"), r6(F.col("adj_r_squared")).alias("adj_r_squared"),
        F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"), r6(F.col("mean_target")).alias("mean_target")))


def terms_of(*factors: str, slope_by: str | None = None) -> list[tuple[str, str]]:
    """(term, SQL) of a design over the fixture's levels, intercept first."""
    out = [("Intercept", "1.0"), (M.PREV, M.PREV)]
    values = _LEVEL_VALUES | {"turnaround_bin": C.S.TURNAROUND_LABELS}
    out += [(f"C({f})[T.{v}]", f"({f} = {v!r})") for f in factors for v in values[f][1:]]
    out += [(c, c) for c in M.NUMERIC_CONTROLS]
    if slope_by:
        out += [(M.slope_term(slope_by, v), f"{M.PREV} * cast({slope_by} = {v!r} as integer)") for v in values[slope_by][1:]]
    return out


def logit_sql(terms: list[tuple[str, str]], steps: int = 9) -> str:
    """CTEs of a logit: ``steps`` weighted least squares steps, each solved by Gauss-Jordan elimination.

    ``beta`` has a row per term (i, term, estimate) and its row ``cov`` of the covariance; ``fit`` has n, dev, dev0.
    """
    p = len(terms)
    parts = ["design as (select [" + ", ".join(f"cast({c} as double)" for _, c in terms)
             + "] as x, cast(current_dep_delayed_15 as double) as y from mf)",
             f"b0 as (select list_transform(range({p}), lambda v: 0.0::double) as beta)"]
    for k in range(1, steps + 1):
        parts.append(f"""w{k} as (select x, m * (1 - m) as w, m * (1 - m) * eta + y - m as u from (
  select x, y, eta, 1 / (1 + exp(-eta)) as m from (
   select x, y, list_dot_product(x, beta) as eta from design, b{k - 1}) t) t)""")
        parts.append(f"""g{k} as (select i, list(v order by j) as cells from (
  select i, j, sum(w * x[i] * x[j]) as v from w{k}, range(1, {p + 1}) a(i), range(1, {p + 1}) c(j) group by i, j) t group by i)""")
        parts.append(f"r{k} as (select i, sum(x[i] * u) as v from w{k}, range(1, {p + 1}) a(i) group by i)")
        unit = (f", list_transform(range(1, {p + 1}), lambda j: case when j = i then 1.0::double else 0.0 end)"
                if k == steps else ", []::double[]")
        parts.append(f"""s{k} as (select 0 as step, i, list_concat(list_concat(cells, [v]){unit}) as cells from g{k} join r{k} using (i)
 union all
 select step + 1, i, case when i = step + 1 then list_transform(cells, lambda v: v / cells[step + 1])
  else list_transform(range(1, len(cells) + 1), lambda j: cells[j] - cells[step + 1] * lead_row[j] / lead_row[step + 1]) end
 from (select *, max(case when i = step + 1 then cells end) over () as lead_row from s{k} where step < {p}) t)""")
        parts.append(f"b{k} as (select list(cells[{p + 1}] order by i) as beta from s{k} where step = {p})")
    parts.append("names(i, term) as (values " + ", ".join(f"({i}, '{t}')" for i, (t, _) in enumerate(terms, 1)) + ")")
    parts.append(f"""beta as (select i, term, cells[{p + 1}] as estimate, cells[{p + 2}:] as cov
  from s{steps} join names using (i) where step = {p})""")
    parts.append(f"""scored as (select y, 1 / (1 + exp(-list_dot_product(x, beta))) as score from design, b{steps})""")
    parts.append("""fit as (select cast(count(*) as double) as n, -2 * sum(y * ln(score) + (1 - y) * ln(1 - score)) as dev,
  -2 * count(*) * (avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))) as dev0, avg(y) as rate from scored)""")
    return recursive(W_LI_MF.rstrip() + ", " + ",\n".join(parts) + "\n")


_CONTROLS = ["OP_UNIQUE_CARRIER", *M.CALENDAR_FACTORS, "current_year"]
LOGIT_SQL = logit_sql(terms_of(*_CONTROLS))
AIRLINE_SQL = logit_sql(terms_of(*_CONTROLS, slope_by="OP_UNIQUE_CARRIER"))
TURNAROUND_SQL = logit_sql(terms_of("turnaround_bin", *_CONTROLS, slope_by="turnaround_bin"))
_COEF_SQL = f"""select '%s' as model, term, round(estimate, 6) as estimate, round(sqrt(cov[i]), 6) as std_err,
 round(estimate - {Z} * sqrt(cov[i]), 6) as ci_lower, round(estimate + {Z} * sqrt(cov[i]), 6) as ci_upper,
 round(exp(estimate), 5) as odds_ratio from beta"""
# areas of the score curve: tied scores are one step
_AREA_SQL = """, tied as (select score, sum(y) as tp, sum(1 - y) as fp from scored group by score),
curve as (select *, sum(tp) over w as ctp, sum(fp) over w as cfp from tied
  window w as (order by score desc rows between unbounded preceding and current row)),
area as (select sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)) as auc, sum(tp * ctp / (ctp + cfp)) / sum(tp) as ap from curve)
"""


def _coef(*models):
    return lambda spark, sf: suite_of(spark, sf, *models)["coefficients"].select(
        "model", "term", *[r6(F.col(c)).alias(c) for c in ("estimate", "std_err", "ci_lower", "ci_upper")],
        F.round("odds_ratio", 5).alias("odds_ratio"))


query("logit_carryover", LOGIT_SQL + _COEF_SQL % "logistic")(_coef("logistic"))
query("logit_airline", AIRLINE_SQL + _COEF_SQL % "logistic_airline_interaction")(_coef("airline"))
query("logit_turnaround", TURNAROUND_SQL + _COEF_SQL % "logistic_turnaround_interaction")(_coef("turnaround"))
_OLS_COEF_SQL = OLS_SQL + f"""select 'linear' as model, term, round(estimate, 6) as estimate,
 round(sqrt(spread * rss / (n - k)), 6) as std_err,
 round(estimate - {_t_sql('n - k')} * sqrt(spread * rss / (n - k)), 6) as ci_lower,
 round(estimate + {_t_sql('n - k')} * sqrt(spread * rss / (n - k)), 6) as ci_upper,
 cast(null as double) as odds_ratio from beta, fit"""
query("coefficients", " union all ".join(f"select * from ({sql})" for sql in (
    _OLS_COEF_SQL, LOGIT_SQL + _COEF_SQL % "logistic", AIRLINE_SQL + _COEF_SQL % "logistic_airline_interaction",
    TURNAROUND_SQL + _COEF_SQL % "logistic_turnaround_interaction")))(_coef(*SU.MODELS))
query("logistic_metrics", LOGIT_SQL + _AREA_SQL + """select 'logistic' as model, n as n_obs,
 round(dev + 2 * (select count(*) from beta), 4) as aic, round(dev, 4) as deviance, round(dev0, 4) as null_deviance,
 round(auc, 6) as roc_auc, round(ap, 6) as average_precision, round(rate, 6) as mean_target, true as converged
 from fit, area""")(
    lambda spark, sf: suite_of(spark, sf, "logistic")["metrics"].select(
        "model", "n_obs", *[F.round(c, 4).alias(c) for c in ("aic", "deviance", "null_deviance")],
        *[r6(F.col(c)).alias(c) for c in ("roc_auc", "average_precision", "mean_target")], "converged"))
query("predict_scores", LOGIT_SQL + """select round(score, 4) as probability, y as label,
 cast(count(*) as bigint) as n from scored group by all""")(
    lambda spark, sf: suite_of(spark, sf, "logistic")["predict_scores"].groupBy(
        F.round("prediction", 4).alias("probability"), "label").agg(F.count(F.lit(1)).alias("n")))


def slopes_sql(sql: str, by: str, levels: list) -> str:
    """``slopes`` (level, b, se): the previous delay's slope at each level, by its contrast."""
    base = levels[0]
    return sql + f""", prev as (select estimate, cov, i from beta where term = '{M.PREV}'),
slopes as (select '{base}' as level, estimate as b, sqrt(cov[i]) as se from prev
 union all select split_part(split_part(t.term, '[T.', 2), ']', 1), p.estimate + t.estimate,
  sqrt(p.cov[p.i] + t.cov[t.i] + 2 * p.cov[t.i]) from prev p, beta t where t.term like '{M.PREV}:%'),
counts as (select cast({by} as varchar) as level, cast(count(*) as bigint) as n_obs from mf group by 1)
"""


_AIR_SLOPES = slopes_sql(AIRLINE_SQL, "OP_UNIQUE_CARRIER", _LEVEL_VALUES["OP_UNIQUE_CARRIER"])
_TURN_SLOPES = slopes_sql(TURNAROUND_SQL, "turnaround_bin", C.S.TURNAROUND_LABELS)
_SLOPE_COLS = """round(b, 6) as carryover_log_odds_per_1_min, round(se, 6) as std_err, round(b - 1.96 * se, 6) as ci_lower,
 round(b + 1.96 * se, 6) as ci_upper, round(exp(10 * b), 4) as odds_ratio_per_10_min,
 round(exp(10 * (b - 1.96 * se)), 4) as or10_ci_lower, round(exp(10 * (b + 1.96 * se)), 4) as or10_ci_upper,
 n_obs from slopes join counts using (level)"""


def _slopes(table: DataFrame) -> DataFrame:
    return table.select(table.columns[0], *[r6(F.col(c)).alias(c) for c in table.columns[1:5]],
                        *[F.round(c, 4).alias(c) for c in table.columns[5:8]], "n_obs")


query("airline_carryover", _AIR_SLOPES + f"select level as airline, {_SLOPE_COLS}")(
    lambda spark, sf: _slopes(suite_of(spark, sf, "airline")["airline_carryover"]))
query("turnaround_carryover", _TURN_SLOPES + f"select level as turnaround_bin, {_SLOPE_COLS}")(
    lambda spark, sf: _slopes(suite_of(spark, sf, "turnaround")["turnaround_carryover"]))


@query("slope_contrast", _TURN_SLOPES + "select level, round(b, 6) as carryover_log_odds_per_1_min, round(se, 6) as std_err from slopes")
def q_slope_contrast(spark, sf):
    """Slope of every turnaround bin: previous delay plus the bin's interaction."""
    return rounded(suite_of(spark, sf, "turnaround")["turnaround_carryover"].select(
        F.col("turnaround_bin").alias("level"), "carryover_log_odds_per_1_min", "std_err"))


query("rank_airlines", _AIR_SLOPES + f"select level as airline, {_SLOPE_COLS} order by b desc, level limit 10")(
    lambda spark, sf: _slopes(R.rank_by(suite_of(spark, sf, "airline")["airline_carryover"],
                                        "odds_ratio_per_10_min", 10, tie="airline")))
query("top_bottom_airlines", _AIR_SLOPES + f""", shown as (select level as airline, b, {_SLOPE_COLS})
select * exclude (b) from (select *, 'top' as part from shown order by b desc, airline limit 6)
union all select * exclude (b) from (select *, 'bottom' as part from shown order by b, airline limit 6)""")(
    lambda spark, sf: (lambda t: t.select(
        "airline", *[r6(F.col(c)).alias(c) for c in t.columns[1:5]], *[F.round(c, 4).alias(c) for c in t.columns[5:8]],
        "n_obs", "part"))(R.top_bottom(suite_of(spark, sf, "airline")["airline_carryover"],
                                       "odds_ratio_per_10_min", 6, tie="airline")))


def joined_sql() -> str:
    """The full linear and logistic models side by side: ``odds``-like row ``pair_fit``."""
    linear = OLS_SQL[OLS_SQL.index("design as ("):]
    for name in ("design", "gram", "system", "solved", "beta", "fit"):
        linear = re.sub(rf"\b{name}\b", f"l_{name}", linear)
    return LOGIT_SQL.rstrip() + ", " + linear.rstrip() + f""",
pair_fit as (select f.n, f.rate, b.estimate as g, sqrt(b.cov[b.i]) as gse, lb.estimate as l,
  sqrt(lb.spread * lf.rss / (lf.n - lf.k)) as lse, {_t_sql('lf.n - lf.k')} as mult, 1 - lf.rss / lf.tss as r2
  from fit f, l_fit lf, beta b join l_beta lb using (term) where term = '{M.PREV}')
"""


BOTH_SQL = joined_sql()
_LINEAR_RESULT = """round(l, 6) as linear_prev_arr_delay_coef, round(l - mult * lse, 6) as linear_ci_lower,
 round(l + mult * lse, 6) as linear_ci_upper, round(10 * l, 6) as minutes_carried_per_10_min_prev_delay from pair_fit"""
query("main_result", BOTH_SQL + f"""select cast(n as bigint) as n_modeling_pairs, round(g, 6) as logistic_prev_arr_delay_coef,
 round(g - {Z} * gse, 6) as logistic_ci_lower, round(g + {Z} * gse, 6) as logistic_ci_upper,
 round(exp(g), 6) as logistic_odds_ratio_per_1_min, round(exp(10 * g), 5) as logistic_odds_ratio_per_10_min,
 round(exp(10 * (g - {Z} * gse)), 5) as logistic_or10_ci_lower, round(exp(10 * (g + {Z} * gse)), 5) as logistic_or10_ci_upper,
 {_LINEAR_RESULT}""")(
    lambda spark, sf: (lambda t: t.select(*[F.round(c, 5 if "10" in c and "logistic" in c else 6).alias(c) if k == "double"
                                            else F.col(c) for c, k in t.dtypes]))(
        suite_of(spark, sf, "linear", "logistic")["main_result"]))
query("secondary_result", BOTH_SQL + f"select {_LINEAR_RESULT}")(
    lambda spark, sf: rounded(suite_of(spark, sf, "linear", "logistic")["secondary_result"]))


@query("per10_scaling", W_LI_MF + f"""
select current_year as year, round(b, 6) as estimate, round(10 * b, 6) as per_10, round(exp(b), 6) as ratio_per_1,
 round(exp(10 * b), 5) as ratio_per_10 from (select current_year, {_SLOPE_SQL} from mf group by 1) t""")
def q_per10_scaling(spark, sf):
    """Per-minute coefficients of each year scaled to ten minutes, as differences and as ratios."""
    fits = G.grouped_ols(materialize(mf_of(spark, sf), "mf"), "current_year", single())
    rows = spark.createDataFrame([(int(g), float(v["beta"][1])) for g, v in fits.items()], "year int, estimate double")
    return rows.select("year", r6(F.col("estimate")).alias("estimate"), r6(10 * F.col("estimate")).alias("per_10"),
                       r6(F.exp("estimate")).alias("ratio_per_1"), F.round(X.per10("estimate"), 5).alias("ratio_per_10"))


def periods_of(spark, sf, periods) -> DataFrame:
    mf = materialize(mf_of(spark, sf), "mf")
    return SU.fit_periods(spark, mf, periods(SU.years_of(mf)))


def eliminated_sql(k: str, p: int) -> list[str]:
    """CTEs that solve the system ``g{k}``, ``r{k}`` of every group; a column without a pivot gets the coefficient 0."""
    unit = f"list_transform(range(1, {p + 1}), lambda j: case when j = i then 1.0::double else 0.0 end)"
    return [f"""s{k} as (select grp, 0 as step, i, list_concat(list_concat(cells, [v]), {unit}) as cells
  from g{k} join r{k} using (grp, i)
 union all
 select grp, step + 1, i, case when abs(lead_row[step + 1]) < 1e-9 then cells
  when i = step + 1 then list_transform(cells, lambda v: v / cells[step + 1])
  else list_transform(range(1, len(cells) + 1), lambda j: cells[j] - cells[step + 1] * lead_row[j] / lead_row[step + 1]) end
 from (select *, max(case when i = step + 1 then cells end) over (partition by grp) as lead_row
  from s{k} where step < {p}) t)""",
            f"""b{k} as (select grp, list(case when abs(cells[i]) < 1e-9 then 0.0 else cells[{p + 1}] end order by i) as beta,
  max(case when i = 2 then cells[{p + 3}] end) as spread, cast(count(*) filter (where abs(cells[i]) > 1e-9) as integer) as k
  from s{k} where step = {p} group by grp)"""]


def grouped_sql(terms: list[tuple[str, str]], grp: str, steps: int = 10) -> str:
    """CTEs of a linear model and a logit for every group at once; a column that is zero in a group drops out.

    ``period`` has a row per group: n, l and lse (linear slope and error), r2, df, g and gse (logit), auc, ap, rate.
    """
    p = len(terms)

    def solved(k: str, w: str, u: str) -> list[str]:
        return [f"""g{k} as (select grp, i, list(v order by j) as cells from (
  select grp, i, j, sum({w} * x[i] * x[j]) as v from w{k}, range(1, {p + 1}) a(i), range(1, {p + 1}) c(j)
  group by grp, i, j) t group by grp, i)""",
                f"r{k} as (select grp, i, sum(x[i] * {u}) as v from w{k}, range(1, {p + 1}) a(i) group by grp, i)",
                *eliminated_sql(k, p)]

    parts = [f"design as (select {grp} as grp, [" + ", ".join(f"cast({c} as double)" for _, c in terms)
             + "] as x, cast(current_dep_delayed_15 as double) as y, cast(current_DEP_DELAY as double) as d from mf)",
             "wl as (select * from design)", *solved("l", "1.0", "d"),
             """linear as (select grp, cast(count(*) as double) as n, any_value(k) as k, any_value(beta)[2] as l,
  any_value(spread) as spread, sum((d - list_dot_product(x, beta)) ** 2) as rss,
  sum(d * d) - sum(d) * sum(d) / count(*) as tss from design join bl using (grp) group by grp)""",
             f"b0 as (select distinct grp, list_transform(range({p}), lambda v: 0.0::double) as beta from design)"]
    for k in range(1, steps + 1):
        parts.append(f"""w{k} as (select grp, x, m * (1 - m) as w, m * (1 - m) * eta + y - m as u from (
  select grp, x, y, eta, 1 / (1 + exp(-eta)) as m from (
   select grp, x, y, list_dot_product(x, beta) as eta from design join b{k - 1} using (grp)) t) t)""")
        parts += solved(str(k), "w", "u")
    parts.append(f"scored as (select grp, y, 1 / (1 + exp(-list_dot_product(x, beta))) as score from design join b{steps} using (grp))")
    parts.append("""tied as (select grp, score, sum(y) as tp, sum(1 - y) as fp from scored group by grp, score),
curve as (select *, sum(tp) over w as ctp, sum(fp) over w as cfp from tied
  window w as (partition by grp order by score desc rows between unbounded preceding and current row)),
area as (select grp, sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)) as auc, sum(tp * ctp / (ctp + cfp)) / sum(tp) as ap,
  sum(tp) / sum(tp + fp) as rate from curve group by grp)""")
    parts.append(f"""period as (select grp, n, l, sqrt(ls * rss / (n - k)) as lse, n - k as df, 1 - rss / tss as r2,
  beta[2] as g, sqrt(spread) as gse, auc, ap, rate from (select grp, n, k, l, spread as ls, rss, tss from linear) t
  join (select grp, beta, spread from b{steps}) b using (grp) join area using (grp))""")
    return recursive(W_LI_MF.rstrip() + ", " + ",\n".join(parts) + "\n")


YEAR_SQL = grouped_sql(terms_of("OP_UNIQUE_CARRIER", *M.CALENDAR_FACTORS), "current_year")
_YEAR_FIT = f"""cast(n as bigint) as n_modeling_pairs, round(l, 5) as linear_coef,
 round(l - {_t_sql('df')} * lse, 5) as linear_ci_lower, round(l + {_t_sql('df')} * lse, 5) as linear_ci_upper,
 round(10 * l, 5) as minutes_carried_per_10_min, round(r2, 5) as linear_r_squared, round(g, 5) as logistic_coef,
 round(exp(10 * g), 4) as logistic_or_per_10_min, round(exp(10 * (g - {Z} * gse)), 4) as logistic_or10_ci_lower,
 round(exp(10 * (g + {Z} * gse)), 4) as logistic_or10_ci_upper, round(auc, 5) as logistic_auc,
 round(ap, 5) as logistic_average_precision, round(rate, 5) as current_delay_rate_gt15 from period"""


def _periods(table: DataFrame) -> DataFrame:
    """Odds ratios to 4 places, other doubles to 5."""
    return table.select(*[F.round(c, 4 if "_or" in c else 5).alias(c) if k == "double" else F.col(c) for c, k in table.dtypes])


query("fit_by_year", YEAR_SQL + f"""select cast(grp as varchar) as period, grp as start_year, grp as end_year,
 'ok' as status, {_YEAR_FIT}""")(lambda spark, sf: _periods(periods_of(spark, sf, SU.yearly_periods)))
# Windows of three years from the first; years count from the window's own first one.
_WINDOW_TERMS = terms_of("OP_UNIQUE_CARRIER", *M.CALENDAR_FACTORS) + [
    (f"year {k} of the window", f"((current_year - 1995) % 3 = {k})") for k in (1, 2)]
WINDOW_SQL = grouped_sql(_WINDOW_TERMS, "1995 + (current_year - 1995) // 3 * 3")
query("fit_by_window", WINDOW_SQL + f"""select case when grp < 2001 then grp || '-' || (grp + 2) else '2001' end as period,
 cast(grp as integer) as start_year, cast(least(grp + 2, 2001) as integer) as end_year, 'ok' as status, {_YEAR_FIT}""")(
    lambda spark, sf: _periods(periods_of(spark, sf, SU.window_periods)))


@query("year_comparison", YEAR_SQL + f"select * exclude (linear_ci_lower, linear_ci_upper, logistic_or10_ci_lower, "
       f"logistic_or10_ci_upper) from (select grp as year, {_YEAR_FIT}) t")
def q_year_comparison(spark, sf):
    return _periods(periods_of(spark, sf, SU.yearly_periods)).select(
        F.col("start_year").alias("year"), "n_modeling_pairs", "linear_coef",
        "minutes_carried_per_10_min", "linear_r_squared", "logistic_coef", "logistic_or_per_10_min",
        "logistic_auc", "logistic_average_precision", "current_delay_rate_gt15")


query("yearly_summary", YEAR_SQL + f"""select grp as year, cast(n as bigint) as n_modeling_pairs,
 round(exp(10 * g), 4) as logistic_or_per_10min, round(exp(10 * (g - {Z} * gse)), 4) as logistic_or10_ci_lower,
 round(exp(10 * (g + {Z} * gse)), 4) as logistic_or10_ci_upper, round(10 * l, 5) as minutes_carried_per_10min
 from period""")(lambda spark, sf: R.yearly_summary(_periods(periods_of(spark, sf, SU.yearly_periods))))


query("presentation_metrics", BOTH_SQL.rstrip() + _AREA_SQL + """, wide as (select * from pair_fit, area)
select 'n_modeling_pairs' as metric, round(n, 5) as value from wide
union all select 'linear_minutes_carried_per_10_min_prev_delay', round(10 * l, 5) from wide
union all select 'logistic_odds_ratio_per_10_min_prev_delay', round(exp(10 * g), 5) from wide
union all select 'logistic_roc_auc', round(auc, 5) from wide
union all select 'logistic_average_precision', round(ap, 5) from wide
union all select 'linear_r_squared', round(r2, 5) from wide""")(
    lambda spark, sf: (lambda out: rounded(R.presentation_metrics(spark, out["main_result"], out["metrics"]), 5))(
        suite_of(spark, sf, "linear", "logistic")))


# ---------------------------------------------------------------- bootstrap
from knockon.operators import bootstrap as B  # noqa: E402

N_REPS, SEED = 20, 42


def weights_sql(n_reps=N_REPS, seed=SEED) -> str:
    return f""",
btails as (select TAIL_NUM, row_number() over (order by TAIL_NUM) - 1 as idx
  from (select distinct TAIL_NUM from mf where TAIL_NUM is not null) d),
bnt as (select count(*) as n from btails),
bdraws as (select r.range // bnt.n as replicate, r.range % bnt.n as j, bnt.n as n
  from range(0, {n_reps} * (select n from bnt)) r, bnt),
bpicked as (select replicate,
  ('0x' || substr(md5(cast(replicate as varchar) || '|{seed}|' || cast(j as varchar)), 1, 15))::BIGINT % n
    as idx from bdraws),
bw as (select cast(replicate as integer) as replicate, TAIL_NUM, cast(count(*) as bigint) as bootstrap_count
  from bpicked join btails using (idx) group by replicate, TAIL_NUM)
"""


_W_SUFFIX = weights_sql()


def boot_sql(base: str, tail: str) -> str:
    return base.rstrip() + _W_SUFFIX + tail


def weights_of(spark, sf, fx="flights"):
    mf = mf_of(spark, sf, fx)
    return B.cluster_weights(mf.where(F.col("TAIL_NUM").isNotNull()), N_REPS, SEED)


query("cluster_weights", boot_sql(W_FL_MF, "select replicate, TAIL_NUM, bootstrap_count from bw"))(
    lambda spark, sf: weights_of(spark, sf))

query("boot_row_weights", boot_sql(W_FL_MF, """
select event_id, cast(bootstrap_count as double) as weight from mf join bw using (TAIL_NUM)
where replicate = 0 and bootstrap_count > 0"""))(
    lambda spark, sf: B.row_weights(mf_of(spark, sf, "flights"), weights_of(spark, sf), 0).select(
        "event_id", "weight"))


@query("bootstrap_mean_ci", boot_sql(W_FL_MF, """,
ts as (select TAIL_NUM, count(*) as n, sum(current_DEP_DELAY) as sy from mf group by TAIL_NUM),
rm as (select replicate, sum(bootstrap_count * sy) / sum(bootstrap_count * n) as m
  from ts join bw using (TAIL_NUM) group by replicate)
select round(quantile_cont(m, 0.025), 6) as mean_dep_delay_ci_lower,
 round(quantile_cont(m, 0.975), 6) as mean_dep_delay_ci_upper from rm""").replace("\n,\n", ",\n"))
def q_bootstrap_mean_ci(spark, sf):
    mf = mf_of(spark, sf, "flights")
    ts = mf.groupBy("TAIL_NUM").agg(F.count(F.lit(1)).alias("n"), F.sum("current_DEP_DELAY").alias("sy"))
    rm = (ts.join(weights_of(spark, sf), "TAIL_NUM").groupBy("replicate")
          .agg((F.sum(F.col("bootstrap_count") * F.col("sy")) / F.sum(F.col("bootstrap_count") * F.col("n")))
               .alias("mean_dep_delay")))
    ci = B.bootstrap_ci(rm, ["mean_dep_delay"])
    return ci.select(r6(F.col("mean_dep_delay_ci_lower")).alias("mean_dep_delay_ci_lower"),
                     r6(F.col("mean_dep_delay_ci_upper")).alias("mean_dep_delay_ci_upper"))


@query("bootstrap_beta_single", boot_sql(W_FL_MF, """,
ts as (select TAIL_NUM, count(*) as n, sum(prev_ARR_DELAY) as sx, sum(current_DEP_DELAY) as sy,
  sum(prev_ARR_DELAY * current_DEP_DELAY) as sxy, sum(prev_ARR_DELAY * prev_ARR_DELAY) as sxx
  from mf group by TAIL_NUM),
rs as (select replicate, sum(bootstrap_count * n) as n, sum(bootstrap_count * sx) as sx,
  sum(bootstrap_count * sy) as sy, sum(bootstrap_count * sxy) as sxy, sum(bootstrap_count * sxx) as sxx
  from ts join bw using (TAIL_NUM) group by replicate)
select replicate, round((sxy - sx * sy / n) / (sxx - sx * sx / n), 6) as beta_prev_arr_delay from rs""")
       .replace("\n,\n", ",\n"))
def q_bootstrap_beta_single(spark, sf):
    mf = materialize(mf_of(spark, sf, "flights"), "mf")
    weights = B.cluster_weights(mf.where(F.col("TAIL_NUM").isNotNull()), N_REPS, SEED)
    b = B.bootstrap_beta(mf, weights, design=B.bootstrap_design(mf, single=True))
    return b.select("replicate", r6(F.col("beta_prev_arr_delay")).alias("beta_prev_arr_delay"))


query("bootstrap_leg_means", boot_sql(legs_sql("flights", upto="mf"), """
select replicate, tls.leg_index, cast(sum(n_obs * bootstrap_count) as bigint) as n_obs,
 round(sum(n_obs * bootstrap_count * mean_remaining_delay) / sum(n_obs * bootstrap_count), 6)
   as mean_remaining_delay
from tls join bw using (TAIL_NUM) group by replicate, tls.leg_index"""))(
    lambda spark, sf: B.bootstrap_leg_means(tls_of(spark, sf), weights_of(spark, sf)).select(
        "replicate", "leg_index", F.col("n_obs").cast("long").alias("n_obs"),
        r6(F.col("mean_remaining_delay")).alias("mean_remaining_delay")))
query("boot_tail_join", boot_sql(legs_sql("flights", upto="mf"), """
select replicate, TAIL_NUM, tls.leg_index, n_obs, bootstrap_count, n_obs * bootstrap_count as weight
from tls join bw using (TAIL_NUM)"""))(
    lambda spark, sf: tls_of(spark, sf).join(weights_of(spark, sf), "TAIL_NUM").select(
        "replicate", "TAIL_NUM", "leg_index", "n_obs", "bootstrap_count",
        (F.col("n_obs") * F.col("bootstrap_count")).alias("weight")))

def resampled_sql(terms: list[tuple[str, str]]) -> str:
    """CTE ``bbeta`` (replicate, beta_prev_arr_delay): sums of products by tail, weighted and solved by replicate."""
    p = len(terms)
    cells = ", ".join(f"cast({c} as double)" for _, c in terms)
    return ",\n".join([
        f"bx as (select TAIL_NUM, [{cells}] as x, cast(current_DEP_DELAY as double) as y from mf where TAIL_NUM is not null)",
        f"""btg as (select TAIL_NUM, i, j, sum(x[i] * x[j]) as v from bx, range(1, {p + 1}) a(i), range(1, {p + 1}) c(j)
  group by all)""",
        f"btr as (select TAIL_NUM, i, sum(x[i] * y) as v from bx, range(1, {p + 1}) a(i) group by all)",
        """gb as (select grp, i, list(v order by j) as cells from (select replicate as grp, i, j, sum(bootstrap_count * v) as v
  from btg join bw using (TAIL_NUM) group by all) t group by grp, i)""",
        "rb as (select replicate as grp, i, sum(bootstrap_count * v) as v from btr join bw using (TAIL_NUM) group by all)",
        *eliminated_sql("b", p),
        "bbeta as (select cast(grp as integer) as replicate, beta[2] as beta_prev_arr_delay from bb)"])


def resampled_table_sql(fx: str, terms: list[tuple[str, str]]) -> str:
    """CTE ``boot`` (replicate, seed, beta_prev_arr_delay, lambda_decay) with the full design."""
    return recursive(boot_sql(legs_sql(fx, upto="mf"), ", " + resampled_sql(terms) + f""",
blm as (select replicate, leg_index, sum(n_obs * bootstrap_count * mean_remaining_delay) / sum(n_obs * bootstrap_count)
  as mean_remaining_delay from tls join bw using (TAIL_NUM) group by replicate, leg_index),
{fit_sql("blm", "replicate")},
boot as (select replicate, {SEED} as seed, beta_prev_arr_delay, lam as lambda_decay
  from bbeta left join fitted using (replicate))
"""))


_BOOT_CI = ", ".join(f"round(quantile_cont({c}, {q}), 6) as {c}_ci_{side}" for c in ("beta_prev_arr_delay", "lambda_decay")
                     for q, side in ((0.025, "lower"), (0.975, "upper")))
# The one-month fixture has five carriers and one year and month.
_FL_TERMS = ([("Intercept", "1.0"), (M.PREV, M.PREV)]
             + [(v, f"(OP_UNIQUE_CARRIER = '{v}')") for v in ("error", "purchase", "signup", "view")]
             + [t for t in terms_of("current_day_of_week", "dep_period") if t[0] not in ("Intercept", M.PREV)])
BOOT_SQL = resampled_table_sql("flights", _FL_TERMS)


@query("bootstrap_beta", recursive(boot_sql(W_LI_MF, ", " + resampled_sql(terms_of(*_CONTROLS))
                                            + " select replicate, round(beta_prev_arr_delay, 6) as beta_prev_arr_delay from bbeta")))
def q_bootstrap_beta(spark, sf):
    mf = materialize(mf_of(spark, sf, "lineitem"), "mf")
    return rounded(B.bootstrap_beta(mf, B.cluster_weights(mf.where(F.col("TAIL_NUM").isNotNull()), N_REPS, SEED)))


query("bootstrap_lambda", recursive(boot_sql(legs_sql("flights", upto="mf"), """,
blm as (select replicate, leg_index, sum(n_obs * bootstrap_count * mean_remaining_delay) / sum(n_obs * bootstrap_count)
  as mean_remaining_delay from tls join bw using (TAIL_NUM) group by replicate, leg_index), """.replace("\n,\n", ",\n")
    + fit_sql("blm", "replicate") + " select replicate, round(lam, 6) as lambda_decay from fitted")))(
    lambda spark, sf: B.bootstrap_lambda(tls_of(spark, sf), weights_of(spark, sf)).select(
        "replicate", r6(F.col("lambda_decay")).alias("lambda_decay")))


def boot_table_of(spark, sf):
    return B.run_bootstrap(spark, mf_of(spark, sf, "flights"), tls_of(spark, sf), N_REPS, SEED)


BOOT_SINGLE_SQL = recursive(boot_sql(legs_sql("flights", upto="mf"), """,
bts as (select TAIL_NUM, count(*) as n, sum(prev_ARR_DELAY) as sx, sum(current_DEP_DELAY) as sy,
  sum(prev_ARR_DELAY * current_DEP_DELAY) as sxy, sum(prev_ARR_DELAY * prev_ARR_DELAY) as sxx
  from mf group by TAIL_NUM),
brs as (select replicate, sum(bootstrap_count * n) as n, sum(bootstrap_count * sx) as sx,
  sum(bootstrap_count * sy) as sy, sum(bootstrap_count * sxy) as sxy, sum(bootstrap_count * sxx) as sxx
  from bts join bw using (TAIL_NUM) group by replicate),
blm as (select replicate, leg_index, sum(n_obs * bootstrap_count * mean_remaining_delay) / sum(n_obs * bootstrap_count)
  as mean_remaining_delay from tls join bw using (TAIL_NUM) group by replicate, leg_index), """.replace("\n,\n", ",\n")
    + fit_sql("blm", "replicate") + """,
boot as (select replicate, 42 as seed, (sxy - sx * sy / n) / (sxx - sx * sx / n) as beta_prev_arr_delay,
  lam as lambda_decay from brs left join fitted using (replicate))
"""))


def boot_single_of(spark, sf):
    return B.run_bootstrap(spark, mf_of(spark, sf, "flights"), tls_of(spark, sf), N_REPS, SEED, single=True)


query("bootstrap_table_single", BOOT_SINGLE_SQL + """select replicate, seed,
 round(beta_prev_arr_delay, 6) as beta_prev_arr_delay, round(lambda_decay, 6) as lambda_decay from boot""")(
    lambda spark, sf: rounded(boot_single_of(spark, sf)))
query("bootstrap_ci_single", BOOT_SINGLE_SQL + "select " + ", ".join(
    f"round(quantile_cont({c}, {q}), 6) as {c}_ci_{side}" for c in ("beta_prev_arr_delay", "lambda_decay")
    for q, side in ((0.025, "lower"), (0.975, "upper"))) + " from boot")(
    lambda spark, sf: rounded(B.bootstrap_ci(boot_single_of(spark, sf), ["beta_prev_arr_delay", "lambda_decay"])))
query("bootstrap_table", BOOT_SQL + """select replicate, seed, round(beta_prev_arr_delay, 6) as beta_prev_arr_delay,
 round(lambda_decay, 6) as lambda_decay from boot""")(lambda spark, sf: rounded(boot_table_of(spark, sf)))
query("bootstrap_ci", BOOT_SQL + f"select {_BOOT_CI} from boot")(
    lambda spark, sf: rounded(B.bootstrap_ci(boot_table_of(spark, sf), ["beta_prev_arr_delay", "lambda_decay"])))


# ---------------------------------------------------------------- sources and sinks
from knockon.sources import files as SRC  # noqa: E402

# Candidate monthly sources derived from the months present in the multi-year fixture:
# two ZIP spellings and one other CSV for every month, plus a /data/csv/ extract for the
# first half of each year and a file with an unsupported name.
_CANDIDATES_SPARK = [
    ("'/archive/data/raw/On_Time_Reporting_Carrier_On_Time_Performance_1987_present_' || y || '_' || m || '.zip'", None),
    ("'/archive/data/raw/ON_TIME_REPORTING_CARRIER_ON_TIME_PERFORMANCE_1987_PRESENT_' || y || '_' || lpad(m, 2, '0') || '.ZIP'", None),
    ("'/archive/dataset/airlines_' || y || '_' || m || '.csv'", None),
    ("'/archive/data/csv/flight_data_' || y || '_' || lpad(m, 2, '0') || '.csv'", "m <= 6"),
    ("'/archive/dataset/notes_' || y || '_' || m || '.txt'", None),
]


def _candidates_sql(months_sql: str) -> str:
    parts = []
    for expr, cond in _CANDIDATES_SPARK:
        e = expr.replace("|| y ||", "|| cast(y as varchar) ||").replace("|| m ||", "|| cast(m as varchar) ||").replace(
            "lpad(m, 2, '0')", "lpad(cast(m as varchar), 2, '0')")
        parts.append(f"select {e} as path from ({months_sql}) mm" + (f" where {cond}" if cond else ""))
    return " union all ".join(parts)


def _month_patterns_sql(col="name"):
    ys = ", ".join(f"case when regexp_matches({col}, '(?i){p}') then cast(regexp_extract({col}, '(?i){p}', 1) as integer) end"
                   for p in SRC.MONTH_PATTERNS)
    ms = ", ".join(f"case when regexp_matches({col}, '(?i){p}') then cast(regexp_extract({col}, '(?i){p}', 2) as integer) end"
                   for p in SRC.MONTH_PATTERNS)
    return f"coalesce({ys})", f"coalesce({ms})"


_YS, _MS = _month_patterns_sql()
_FX_MONTHS = "select distinct cast(year(FL_DATE) as integer) as y, cast(month(FL_DATE) as integer) as m from clean"


@query("source_pick", cte_chain("lineitem", "clean").rstrip() + f""",
cand as ({_candidates_sql(_FX_MONTHS)}),
named as (select path, regexp_extract(path, '([^/]*)$', 1) as name from cand),
parsed as (select path, name, {_YS} as year, {_MS} as month,
  case when lower(name) like '%.csv' and path like '%/data/csv/%' then 0
       when lower(name) like '%.zip' then 1 when lower(name) like '%.csv' then 2 else 9 end as priority
  from named),
ranked as (select *, row_number() over (partition by year, month order by priority, length(name), path) as rk
  from parsed where year is not null)
select year, month, path from ranked where rk = 1""")
def q_source_pick(spark, sf):
    # written once: the spellings would each clean the flights again, and the name patterns run on every flight
    months = materialize(clean_of(spark, sf, "lineitem").select(
        F.year("FL_DATE").cast("int").alias("y"), F.month("FL_DATE").cast("int").alias("m")).distinct(), "months")
    cands = None
    for expr, cond in _CANDIDATES_SPARK:
        e = expr.replace("|| y ||", "|| cast(y as string) ||").replace("|| m ||", "|| cast(m as string) ||")
        c = months.where(cond) if cond else months
        c = c.select(F.expr(e).alias("path"))
        cands = c if cands is None else cands.unionByName(c)
    return SRC.source_pick(cands)


@query("month_range", cte_chain("lineitem", "clean").rstrip() + """,
b as (select min(date_trunc('month', FL_DATE)) as a, max(date_trunc('month', FL_DATE)) as z from clean)
select cast(year(d) as integer) as year, cast(month(d) as integer) as month
from b, generate_series(b.a, b.z, interval 1 month) g(d)""")
def q_month_range(spark, sf):
    b = clean_of(spark, sf, "lineitem").agg(F.date_format(F.min("FL_DATE"), "yyyy-MM").alias("a"),
                                            F.date_format(F.max("FL_DATE"), "yyyy-MM").alias("z")).first()
    return SRC.month_range(spark, b["a"], b["z"])


# Per month: sums of every number, and distinct values and total length of every text, of the cleaned columns.
_MONTH_NUMBERS = ["CRS_DEP_TIME", "CRS_ARR_TIME", "DEP_DELAY", "ARR_DELAY", "DISTANCE", "CANCELLED", "DIVERTED",
                  "sched_dep_hour", "sched_arr_hour", "month", "day_of_week"]
_MONTH_TEXTS = ["TAIL_NUM", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "route"]
_MONTH_TIMES = ["sched_dep_timestamp", "sched_arr_timestamp"]
_MONTH_VALUES_SQL = cte_chain("lineitem", "clean") + """
select strftime(FL_DATE, '%Y-%m') as ym, cast(count(*) as bigint) as clean_rows, """ + ", ".join(
    [f"cast(sum({c}) as double) as sum_{c}" for c in _MONTH_NUMBERS]
    + [f"cast(count(distinct {c}) as bigint) as n_{c}, cast(sum(length({c})) as bigint) as len_{c}" for c in _MONTH_TEXTS]
    + [f"cast(sum(epoch({c})) as bigint) as sum_{c}" for c in _MONTH_TIMES]) + " from clean group by 1"

# Long-form header spellings used for the derived raw files (alias resolution is exercised).
_LONG_NAMES = {"TAIL_NUM": "Tail_Number", "FL_DATE": "FlightDate", "OP_UNIQUE_CARRIER": "Reporting_Airline",
               "ORIGIN": "Origin", "DEST": "Dest", "CRS_DEP_TIME": "CRSDepTime", "CRS_ARR_TIME": "CRSArrTime",
               "DEP_DELAY": "DepDelay", "ARR_DELAY": "ArrDelay", "DISTANCE": "Distance",
               "CANCELLED": "Cancelled", "DIVERTED": "Diverted"}


def _raw_long(spark, sf):
    raw = raw_flights(spark, sf, "lineitem")
    return raw.select(*[F.col(c).cast("string").alias(_LONG_NAMES[c]) for c in _LONG_NAMES],
                      F.substring("FL_DATE", 1, 7).alias("ym"))


def _month_values(clean):
    return clean.groupBy(F.date_format("FL_DATE", "yyyy-MM").alias("ym")).agg(
        F.count(F.lit(1)).alias("clean_rows"),
        *[F.sum(c).cast("double").alias(f"sum_{c}") for c in _MONTH_NUMBERS],
        *[f(c).cast("long").alias(f"{name}_{c}") for c in _MONTH_TEXTS
          for name, f in (("n", F.count_distinct), ("len", lambda c: F.sum(F.length(c))))],
        *[F.sum(F.unix_seconds(F.col(c).cast("timestamp"))).alias(f"sum_{c}") for c in _MONTH_TIMES])


@query("read_month_csv", _MONTH_VALUES_SQL)
def q_read_month_csv(spark, sf):
    path = scratch_path(spark, "raw_csv")
    _raw_long(spark, sf).write.partitionBy("ym").option("header", True).csv(path)
    raw = SRC.read_month_csv(spark, [path])
    return _month_values(C.clean_flights(raw))


_MIXED_COLS = [*_MONTH_TEXTS, "FL_DATE", *_MONTH_TIMES, *_MONTH_NUMBERS]


def _write_mixed(spark, sf) -> str:
    """One folder, three header layouts: plain; origin/destination and the delays swapped with dates that carry a
    clock; canonical names with month and weekday columns."""
    path = scratch_path(spark, "raw_mixed")
    long = materialize(_raw_long(spark, sf), "raw-long")  # read by three writes
    kind = F.substring("ym", 6, 2).cast("int") % 3
    long.where(kind == 0).drop("ym").write.option("header", True).csv(f"{path}/plain")
    order = [c for c in long.columns if c != "ym"]
    for x, y in (("Origin", "Dest"), ("DepDelay", "ArrDelay")):
        i, j = order.index(x), order.index(y)
        order[i], order[j] = y, x
    clocked = long.where(kind == 1).withColumn(
        "FlightDate", F.date_format(F.to_date("FlightDate"), "M/d/yyyy' 12:00:00 AM'"))
    clocked.select(*order).write.option("header", True).csv(f"{path}/swapped")
    back = {v: k for k, v in _LONG_NAMES.items()}
    day = F.to_date("FlightDate")
    long.where(kind == 2).select(
        *[F.col(c).alias(back[c]) for c in long.columns if c != "ym"], F.month(day).alias("MONTH"),
        X.iso_weekday(day).alias("DAY_OF_WEEK")).write.option("header", True).csv(f"{path}/canonical")
    return path


def _mixed_rows(clean) -> DataFrame:
    return iso(clean.select(*_MIXED_COLS)).withColumns({c: F.col(c).cast("double") for c in _MONTH_NUMBERS})


@query("read_month_mixed", cte_chain("lineitem", "clean") + "select " + ", ".join(
    f"cast({c} as double) as {c}" if c in _MONTH_NUMBERS else iso_sql([c]) for c in _MIXED_COLS) + " from clean")
def q_read_month_mixed(spark, sf):
    """The three header layouts read together, compared row by row."""
    return _mixed_rows(C.clean_flights(SRC.read_month_csv(spark, _write_mixed(spark, sf))))


@query("read_month_zip", _MONTH_VALUES_SQL)
def q_read_month_zip(spark, sf):
    import os
    import zipfile as _zf
    path = scratch_path(spark, "raw_zip")
    local = path.replace("file:", "", 1)

    def write_zips(batches):  # executor side: one archive per month of this task
        import pandas as _pd
        frames = list(batches)
        if not frames:
            return
        pdf = _pd.concat(frames)
        os.makedirs(local, exist_ok=True)
        out = []
        for ym, g in pdf.groupby("ym"):
            y, m = ym.split("-")
            name = f"On_Time_Reporting_Carrier_On_Time_Performance_1987_present_{y}_{int(m)}"
            with _zf.ZipFile(f"{local}/{name}.zip", "w", _zf.ZIP_DEFLATED) as z:
                z.writestr(f"{name}.csv", "\ufeff" + g.drop(columns=["ym"]).to_csv(index=False))
            out.append((ym, len(g)))
        yield _pd.DataFrame(out, columns=["ym", "n"])

    long = _raw_long(spark, sf)
    long.repartition("ym").mapInPandas(write_zips, "ym string, n long").count()
    raw = SRC.read_month_zip(spark, [f"{path}/*.zip"])
    return _month_values(C.clean_flights(raw))


@query("write_clean", _MONTH_VALUES_SQL)
def q_write_clean(spark, sf):
    path = scratch_path(spark, "clean")
    SRC.write_clean(clean_of(spark, sf, "lineitem"), path)
    return _month_values(spark.read.parquet(path))


@query("read_pairs", W_LI_P + """
select cast(year(current_FL_DATE) as integer) as current_year, cast(count(*) as bigint) as n_pairs,
 round(avg(prev_ARR_DELAY), 6) as mean_prev_arr_delay
from pairs where year(current_FL_DATE) between 1996 and 1998 group by 1""")
def q_read_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    SRC.write_pairs(pairs_of(spark, sf, "lineitem"), path)
    p = SRC.read_pairs(spark, path, ["current_year", "prev_ARR_DELAY"], 1996, 1998)
    return p.groupBy("current_year").agg(F.count(F.lit(1)).alias("n_pairs"),
                                         r6(F.avg("prev_ARR_DELAY")).alias("mean_prev_arr_delay"))


@query("write_reports", legs_sql() + """
select leg_index, n_obs, round(mean_remaining_delay, 6) as mean_remaining_delay,
 round(median_remaining_delay, 6) as median_remaining_delay from dbl""")
def q_write_reports(spark, sf):
    path = scratch_path(spark, "report_decay_by_leg")
    R.write_report(D.decay_by_leg(tls_of(spark, sf)), path)
    back = spark.read.option("header", True).schema(
        "leg_index int, n_obs long, mean_remaining_delay double, median_remaining_delay double").csv(path)
    return back.select("leg_index", "n_obs", r6(F.col("mean_remaining_delay")).alias("mean_remaining_delay"),
                       r6(F.col("median_remaining_delay")).alias("median_remaining_delay"))


_WIDE = {"Year": "substr(FL_DATE, 1, 4)", "Month": "substr(FL_DATE, 6, 2)", "DayofMonth": "substr(FL_DATE, 9, 2)",
         "FlightDate": "FL_DATE", "Reporting_Airline": "OP_UNIQUE_CARRIER", "Origin": "ORIGIN", "Dest": "DEST",
         "CRSDepTime": "CRS_DEP_TIME", "DepDelay": "DEP_DELAY", "CRSArrTime": "CRS_ARR_TIME", "ArrDelay": "ARR_DELAY",
         "Cancelled": "CANCELLED", "Diverted": "DIVERTED", "Distance": "DISTANCE"}
_WIDE |= {c: f"concat('{c[:3]}', cast(l_partkey % {7 + i} as varchar(9)))"
          for i, c in enumerate(C.S.TRIM_COLUMNS) if c not in _WIDE}


@query("trim_columns", cte_chain("lineitem", "clean").rstrip() + ", wide as (select " + ", ".join(
    f"coalesce(cast({e} as varchar), '') as {c}" for c, e in _WIDE.items()) + """ from fx)
select cast(count(*) as bigint) as n_rows, """ + ", ".join(
    f"cast(count(distinct {c}) as bigint) as n_{c}, cast(sum(length({c})) as bigint) as len_{c}, min({c}) as min_{c}, max({c}) as max_{c}"
    for c in C.S.TRIM_COLUMNS) + " from wide")
def q_trim_columns(spark, sf):
    raw = raw_flights(spark, sf, "lineitem")
    wide = raw.select(*[F.expr(f"cast({_WIDE[c]} as string)").alias(c) for c in C.S.TRIM_COLUMNS],
                      F.col("TAIL_NUM").alias("Tail_Number"), F.lit("x").alias("Div1Airport"))
    path = scratch_path(spark, "wide_csv")
    wide.write.option("header", True).csv(path)
    return column_values(SRC.trim_columns(spark.read.option("header", True).csv(path)), C.S.TRIM_COLUMNS)


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and for every text column its distinct values, total length, least and greatest value, in one row.

    Rows turn into (column, value) and are counted by both before the shuffle; distinct
    counts side by side would copy the wide row for every column instead.
    """
    cells = df.select(F.posexplode(F.array(*columns)).alias("at", "value"))
    values = cells.groupBy("at", "value").agg(F.count(F.lit(1)).alias("times"))
    each = values.groupBy("at").agg(
        F.sum("times").alias("rows"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum(F.col("times") * F.length("value")).alias("len"))

    def of(i: int, name: str):
        return F.max(F.when(F.col("at") == i, F.col(name)))
    none = F.lit(0).cast("long")
    return each.agg(F.coalesce(of(0, "rows"), none).alias("n_rows"), *[
        (F.coalesce(of(i, name), none) if name == "n" else of(i, name)).alias(f"{name}_{c}")
        for i, c in enumerate(columns) for name in ("n", "len", "min", "max")])


# ---------------------------------------------------------------- streaming ingest, summaries
from knockon.streaming import ingest as ST  # noqa: E402


@query("stream_clean_ingest", ORACLES["read_month_mixed"])
def q_stream_clean_ingest(spark, sf):
    """A landing folder of three header layouts, cleaned by the stream and compared row by row."""
    out, ck = (scratch_path(spark, n) for n in ("stream_clean", "stream_ckpt"))
    ST.run_clean_ingest(spark, _write_mixed(spark, sf), out, ck)
    return _mixed_rows(spark.read.parquet(out))


# ---------------------------------------------------------------- chains from a layout, months one by one
from knockon.operators import append as AP  # noqa: E402
from knockon.sources import layout as LAY  # noqa: E402


def laid_out(spark, sf, fx="flights") -> DataFrame:
    """Cleaned flights as a table bucketed by tail and chain bucket, in chain order."""
    path = scratch_path(spark, "layout")
    return LAY.write_chain_layout(stage_of(spark, sf, fx), path, "layout_" + path[-12:], P.chain_order(ids(fx)))


query("pairs_from_layout", ORACLES["flight_pairs_multi_year"])(
    lambda spark, sf: iso(P.flight_pairs(laid_out(spark, sf, "lineitem"), tiebreak=ids("lineitem"), split=LAY.BUCKET,
                                         keep=ids("lineitem")).select(*LI_PAIR_OUT)))

query("later_legs_from_layout", ORACLES["later_legs"])(
    lambda spark, sf: D.later_legs(laid_out(spark, sf), tiebreak=ids(), split=LAY.BUCKET).select("event_id", *LEG_COLS))


@query("pairs_by_append", ORACLES["flight_pairs_multi_year"])
def q_pairs_by_append(spark, sf):
    """Years added one after the other, each reading its own flights and the last legs before it."""
    clean = stage_of(spark, sf, "lineitem", P.PAIR_INPUTS)
    store = AP.PairStore(spark, scratch_path(spark, "pair_store"), ids("lineitem"), ids("lineitem"))
    for year in SU.years_of(clean.select(F.year("FL_DATE").alias("current_year"))):
        store.add(f"{year}-12", clean.where(F.year("FL_DATE") == year))
    return iso(store.pairs().select(*LI_PAIR_OUT))


@query("summary_assemble", cte_chain("lineitem", "mf") + """
select t.total_cleaned_flights, t.total_flight_pairs, m.n_obs, m.mean_dep_delay, s.slope
from (select (select cast(count(*) as bigint) from clean) as total_cleaned_flights,
             (select cast(count(*) as bigint) from pairs) as total_flight_pairs) t,
     (select cast(count(*) as bigint) as n_obs, round(avg(current_DEP_DELAY), 6) as mean_dep_delay from mf) m,
     (select round(regr_slope(current_DEP_DELAY, prev_ARR_DELAY), 6) as slope from mf) s""")
def q_summary_assemble(spark, sf):
    clean = pair_stage_of(spark, sf, "lineitem")
    pairs = P.flight_pairs(clean, tiebreak=ids("lineitem"), keep=ids("lineitem"))
    mf = FE.model_frame(pairs, keep=ids("lineitem"))
    t = R.dataset_totals(clean, pairs).select("total_cleaned_flights", "total_flight_pairs")
    m = mf.agg(F.count(F.lit(1)).alias("n_obs"), r6(F.avg("current_DEP_DELAY")).alias("mean_dep_delay"),
               r6(F.regr_slope("current_DEP_DELAY", "prev_ARR_DELAY")).alias("slope"))
    return R._one_row_join(t, m)


_SUMMARY_CURVE = recursive(legs_sql("lineitem").rstrip() + ", one as (select 1 as grp, * from dbl), " + fit_sql("one"))


@query("final_summary", f"""select t.*, m.*, b.*, d.* from
 ({W_LI_P}select cast((select count(distinct strftime(FL_DATE, '%Y-%m')) from clean) as bigint) as total_raw_files_used,
  cast((select count(*) from clean) as bigint) as total_cleaned_flights,
  cast((select count(*) from pairs) as bigint) as total_flight_pairs) t,
 ({BOTH_SQL}select round(l, 6) as main_carryover_coefficient, round(g, 6) as logistic_prev_delay_coefficient,
  round(exp(g), 6) as logistic_prev_delay_odds_ratio, round(exp(10 * g), 5) as logistic_odds_ratio_per_10_min,
  round(exp(10 * (g - {Z} * gse)), 5) as logistic_or10_ci_lower,
  round(exp(10 * (g + {Z} * gse)), 5) as logistic_or10_ci_upper from pair_fit) m,
 ({resampled_table_sql("lineitem", terms_of(*_CONTROLS))}select
  round(quantile_cont(beta_prev_arr_delay, 0.025), 6) as bootstrap_ci_lower,
  round(quantile_cont(beta_prev_arr_delay, 0.975), 6) as bootstrap_ci_upper,
  round(quantile_cont(lambda_decay, 0.025), 6) as decay_lambda_ci_lower,
  round(quantile_cont(lambda_decay, 0.975), 6) as decay_lambda_ci_upper from boot) b,
 ({_SUMMARY_CURVE} select round(lam, 6) as decay_lambda,
  case when lam > 0 then round(ln(2) / lam, 5) end as decay_half_life_legs from fitted) d""")
def q_final_summary(spark, sf):
    """Totals, models, decay and bootstrap from one clean table and one chain pass."""
    clean = pair_stage_of(spark, sf, "lineitem")
    cand = materialize(P.pair_candidates(clean, tiebreak=ids("lineitem"), keep=ids("lineitem"), max_lead=5), "chain")
    pairs = cand.where(P.connection_filter()).select(*ids("lineitem"), *C.S.PAIR_COLUMNS)
    mf = FE.model_frame(pairs, keep=ids("lineitem"))
    suite = SU.fit_suite(spark, mf, models=("linear", "logistic"))
    tls = D.tail_leg_summary_of_legs(cand, arr_col="current_ARR_DELAY")
    params = D.decay_parameters(D.decay_by_leg(tls))
    boot = B.run_bootstrap(spark, mf, tls, N_REPS, SEED)
    ci = B.bootstrap_ci(boot, ["beta_prev_arr_delay", "lambda_decay"])
    out = R.final_summary(R.dataset_totals(clean, pairs), suite["coefficients"], suite["main_result"], params, ci)
    return out.select(*[F.round(c, 5 if "10" in c or "half_life" in c else 6).alias(c) if k == "double" else F.col(c)
                        for c, k in out.dtypes])


# ---------------------------------------------------------------- chain order, decay curve evaluation
@query("chain_sort", W_FL + """
select event_id, TAIL_NUM, cast(row_number() over (partition by TAIL_NUM
  order by sched_dep_timestamp asc nulls last, event_id) as bigint) as chain_position from clean""")
def q_chain_sort(spark, sf):
    return P.chain_sort(stage_of(spark, sf), tiebreak=ids()).select("event_id", "TAIL_NUM", "chain_position")


@query("chain_sort_multi_year", cte_chain("lineitem", "clean") + """
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(row_number() over (partition by TAIL_NUM
  order by sched_dep_timestamp asc nulls last, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as bigint)
  as chain_position from clean""")
def q_chain_sort_multi_year(spark, sf):
    return P.chain_sort(stage_of(spark, sf, "lineitem"), tiebreak=ids("lineitem")).select(
        *FX.FX_LINEITEM_ORDER, "chain_position")


@query("decay_eval", ONE_CURVE + f""" select cast(k as integer) as leg_index, {A_LAMBDA},
 round(amplitude_A * exp(-lam * k), 5) as decay_value,
 case when lam > 0 then round(ln(2) / lam, 5) end as half_life_legs from fitted, range(1, 6) r(k)""")
def q_decay_eval(spark, sf):
    """A*exp(-lambda*k) on the fitted curve for k = 1..5 and the half-life (null unless lambda > 0)."""
    params = D.fit_groups(D.decay_by_leg(tls_of(spark, sf)), [])
    legs = params.select("amplitude_A", "lambda", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("leg_index"))
    return a_lambda(legs, "leg_index", F.round(X.decay_value("amplitude_A", "lambda", "leg_index"), 5).alias(
        "decay_value"), F.round(X.half_life("lambda"), 5).alias("half_life_legs"))


# zlib's crc32, bit by bit over the (ASCII) tails: step s takes in byte s / 8 at its first bit
CRC_SQL = recursive(cte_chain("lineitem", "cand").rstrip() + """,
bits as (select TAIL_NUM, 0 as s, cast(4294967295 as bigint) as crc from (select distinct TAIL_NUM from clean) t
 union all
 select TAIL_NUM, s + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end
 from (select TAIL_NUM, s, case when s % 8 = 0 then xor(crc, cast(ascii(substr(TAIL_NUM, s // 8 + 1, 1)) as bigint))
                           else crc end as x from bits where s < 8 * length(TAIL_NUM)) b),
buckets as (select TAIL_NUM, cast(xor(crc, 4294967295) % 100 as integer) as partition_id
 from bits where s = 8 * length(TAIL_NUM))
""")
query("pair_summary_by_partition", CRC_SQL + """
select partition_id, cast(count(*) as bigint) as raw_rows,
 cast(count(prev_sched_arr_timestamp) as bigint) as candidate_pairs,
 cast(count(*) filter (where same_airport_connection = 1) as bigint) as same_airport_pairs,
 cast(count(*) filter (where same_airport_connection = 1
   and scheduled_turnaround_minutes between 20 and 600) as bigint) as output_pairs
from cand join buckets using (TAIL_NUM) group by partition_id""")(
    lambda spark, sf: P.pair_summary(P.partition_ids(stage_of(spark, sf, "lineitem"), 100),
                                     by=["partition_id"], tiebreak=ids("lineitem")))



@query("tail_partition", CRC_SQL + " select TAIL_NUM, partition_id from buckets")
def q_tail_partition(spark, sf):
    path = scratch_path(spark, "tail_parts")
    SRC.write_tail_partitions(clean_of(spark, sf, "lineitem"), path, 100)
    return spark.read.parquet(path).select("TAIL_NUM", "partition_id").distinct()


query("partition_stats", CRC_SQL + """ select partition_id, cast(count(*) as bigint) as rows
from clean join buckets using (TAIL_NUM) group by partition_id""")(
    lambda spark, sf: P.partition_stats(clean_of(spark, sf, "lineitem"), 100))


def _poisson_case_sql(u: str) -> str:
    th = B.poisson_thresholds()
    return ("case " + " ".join(f"when {u} < {c!r} then {k}" for k, c in enumerate(th))
            + f" else {len(th)} end")


@query("cluster_weights_poisson", W_FL_MF.rstrip() + f""",
pt as (select distinct TAIL_NUM from mf where TAIL_NUM is not null),
pr as (select TAIL_NUM, r.range as replicate from pt, range(0, {N_REPS}) r),
pu as (select replicate, TAIL_NUM,
  cast(('0x' || substr(md5(cast(replicate as varchar) || '|{SEED}|' || TAIL_NUM), 1, 13))::BIGINT as double)
    / {float(2 ** 52)!r} as u from pr)
select cast(replicate as integer) as replicate, TAIL_NUM,
 cast({_poisson_case_sql("u")} as bigint) as bootstrap_count
from pu where {_poisson_case_sql("u")} > 0""")
def q_cluster_weights_poisson(spark, sf):
    mf = mf_of(spark, sf, "flights")
    return B.poisson_weights(mf.where(F.col("TAIL_NUM").isNotNull()), N_REPS, SEED)


query("decay_by_leg_by_carrier", legs_sql().replace(
    "legs as (select event_id, TAIL_NUM, ARR_DELAY, DEP_DELAY,",
    "legs as (select event_id, TAIL_NUM, OP_UNIQUE_CARRIER, ARR_DELAY, DEP_DELAY,") + """,
lc as (select OP_UNIQUE_CARRIER, k as leg_index,
  case k """ + " ".join(f"when {i} then next_dep_delay_{i}" for i in range(1, 6)) + """ end as v
  from shock cross join range(1, 6) r(k))
select OP_UNIQUE_CARRIER, cast(leg_index as integer) as leg_index, cast(count(*) as bigint) as n_obs,
 round(avg(v), 6) as mean_remaining_delay
from lc where v is not null group by OP_UNIQUE_CARRIER, leg_index""".replace("\n,\n", ",\n"))(
    lambda spark, sf: D.decay_by_leg_by(stage_of(spark, sf), ["OP_UNIQUE_CARRIER"], tiebreak=ids()).select(
        "OP_UNIQUE_CARRIER", "leg_index", "n_obs",
        r6(F.col("mean_remaining_delay")).alias("mean_remaining_delay")))



@query("clean_summary_by_file", cte_chain("lineitem", "clean") + """
select strftime(FL_DATE, '%Y-%m') as input_month, cast(count(*) as bigint) as input_rows,
 cast(count(*) filter (where coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1) as bigint)
   as output_rows,
 cast(count(distinct case when coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1
   then TAIL_NUM end) as bigint) as distinct_tail_numbers,
""" + ",\n".join(f" cast(count(*) filter (where {c} is null) as bigint) as missing_{c}"
                 for c in C.S.REQUIRED_COLUMNS) + " from typed group by 1")
def q_clean_summary_by_file(spark, sf):
    """Per raw input file (one per month): rows in / out, tails, nulls per required column."""
    path = scratch_path(spark, "raw_csv_by_file")
    _raw_long(spark, sf).write.partitionBy("ym").option("header", True).csv(path)
    raw = SRC.read_month_csv(spark, [path], with_source=True)
    month = F.regexp_extract("source_path", r"ym=([0-9]{4}-[0-9]{2})", 1).alias("input_month")
    return C.clean_summary(raw, by=[month], keep=["source_path"])


# ---------------------------------------------------------------- counts and guards of the writing pass
from knockon.sources import counted as CO  # noqa: E402


@query("write_clean_counted", ORACLES["clean_summary"])
def q_write_clean_counted(spark, sf):
    """The clean summary from the pass that writes the clean table."""
    path = scratch_path(spark, "clean_counted")
    return CO.clean_summary(spark, path, CO.write_clean(raw_flights(spark, sf), path, keep=ids()))


@query("write_pairs_counted", ORACLES["pair_summary"].replace("select OP_UNIQUE_CARRIER, cast", "select cast")
       .replace("from cand group by OP_UNIQUE_CARRIER", "from cand"))
def q_write_pairs_counted(spark, sf):
    """The pair summary from the pass that writes the pairs."""
    counts = CO.write_pairs(stage_of(spark, sf), scratch_path(spark, "pairs_counted"), tiebreak=ids(), keep=ids())
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


@query("require_rows", W_FL_P + """select name, n, least, n >= least as enough from (
 select 'output_rows' as name, cast((select count(*) from clean) as bigint) as n, cast(1 as bigint) as least
 union all select 'output_pairs', cast((select count(*) from pairs) as bigint), 1
 union all select 'output_pairs', cast((select count(*) from pairs) as bigint), 1000000000) t""")
def q_require_rows(spark, sf):
    """The guards on the counts of both writes; the last asks for more pairs than there are."""
    cleaned, paired = (scratch_path(spark, n) for n in ("clean_counted", "pairs_counted"))
    counts = CO.write_clean(raw_flights(spark, sf), cleaned, keep=ids())
    counts |= CO.write_pairs(spark.read.parquet(cleaned), paired, tiebreak=ids(), keep=ids())

    def held(name: str, least: int) -> tuple:
        try:
            return name, CO.require_rows(counts, name, least), least, True
        except CO.TooFewRowsError:
            return name, counts[name], least, False
    return spark.createDataFrame([held("output_rows", 1), held("output_pairs", 1), held("output_pairs", 10 ** 9)],
                                 "name string, n long, least long, enough boolean")


@query("require_columns", cte_chain("lineitem", "clean") + """select strftime(FL_DATE, '%Y') as year,
 case cast(year(FL_DATE) as integer) % 3 when 0 then 'DEP_DELAY' when 1 then 'ORIGIN,DEST' else '' end as missing
from typed group by all""")
def q_require_columns(spark, sf):
    """Raw files by year, some without columns that a month needs; what each file's header lacks."""
    path = scratch_path(spark, "raw_lacking")
    raw = _raw_long(spark, sf).withColumn("year", F.substring("ym", 1, 4)).drop("ym")
    for rest, lacking in ((0, ["DepDelay"]), (1, ["Origin", "Dest"]), (2, [])):
        (raw.where(F.col("year").cast("int") % 3 == rest).drop(*lacking)
         .write.partitionBy("year").option("header", True).csv(f"{path}/{rest}"))
    return CO.missing_columns(spark, path).select(
        F.regexp_extract("path", "year=([0-9]{4})", 1).alias("year"),
        F.array_join("missing", ",").alias("missing")).distinct()


@query("tail_leg_summary_shared_chain", legs_sql() + """
select TAIL_NUM, leg_index, n_obs, round(mean_remaining_delay, 6) as mean_remaining_delay,
 round(median_remaining_delay, 6) as median_remaining_delay from tls""")
def q_tls_shared(spark, sf):
    """Tail-leg summary read off the pair candidates (one chain pass for W1 and W2)."""
    cand = P.pair_candidates(stage_of(spark, sf), tiebreak=ids(), keep=ids(), max_lead=5)
    t = D.tail_leg_summary_of_legs(cand, arr_col="current_ARR_DELAY")
    return t.select("TAIL_NUM", "leg_index", "n_obs",
                    r6(F.col("mean_remaining_delay")).alias("mean_remaining_delay"),
                    r6(F.col("median_remaining_delay")).alias("median_remaining_delay"))
