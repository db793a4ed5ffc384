"""DuckDB oracle SQL building blocks (independent re-statement of the semantics).

Each registered query has an ANSI-SQL twin that DuckDB runs over the same
parquet tables.  The blocks below are CTE chains: fixture -> typed -> clean ->
candidate pairs -> pairs -> model frame.
"""

from __future__ import annotations

from knockon.sources.fixtures import (FX_FLIGHTS_ORDER, FX_FLIGHTS_SQL, FX_LINEITEM_FLIGHTS_SQL,
                                      FX_LINEITEM_ORDER)

FIXTURES = {
    "flights": (FX_FLIGHTS_SQL, FX_FLIGHTS_ORDER),
    "lineitem": (FX_LINEITEM_FLIGHTS_SQL, FX_LINEITEM_ORDER),
}


def _hhmm(col: str, p: str) -> str:
    return (f"case when {col} > -1 and {col} < 2401 then cast(trunc({col}) as integer) end as {p}w")


def cte_chain(fx: str, upto: str = "pairs") -> str:
    """``with`` clause defining views fx, typed, clean, cand, pairs, mf (model frame)."""
    sql, ids = FIXTURES[fx]
    idl = ", ".join(ids)
    parts = [f"fx as ({sql.strip()})"]
    parts.append(f"""typed as (
 select {idl}, trim(cast(TAIL_NUM as varchar)) as TAIL_NUM,
  try_cast(FL_DATE as date) as FL_DATE,
  cast(OP_UNIQUE_CARRIER as varchar) as OP_UNIQUE_CARRIER,
  cast(ORIGIN as varchar) as ORIGIN, cast(DEST as varchar) as DEST,
  cast(CRS_DEP_TIME as double) as CRS_DEP_TIME, cast(CRS_ARR_TIME as double) as CRS_ARR_TIME,
  cast(DEP_DELAY as double) as DEP_DELAY, cast(ARR_DELAY as double) as ARR_DELAY,
  cast(DISTANCE as double) as DISTANCE, cast(CANCELLED as double) as CANCELLED,
  cast(DIVERTED as double) as DIVERTED
 from fx)""")
    parts.append("""kept as (
 select * from typed
 where TAIL_NUM is not null and TAIL_NUM <> '' and FL_DATE is not null
   and CRS_DEP_TIME is not null and CRS_ARR_TIME is not null
   and coalesce(CANCELLED, 0) <> 1 and coalesce(DIVERTED, 0) <> 1)""")
    parts.append(f"""hh as (
 select *, {_hhmm('CRS_DEP_TIME', 'd')}, {_hhmm('CRS_ARR_TIME', 'a')} from kept)""")
    parts.append("""hh2 as (
 select *, case when dw = 2400 then 0 else dw end as dc, case when aw = 2400 then 0 else aw end as ac
 from hh)""")
    parts.append("""hh3 as (
 select *,
  coalesce(dw is not null and dc // 100 between 0 and 23 and dc % 100 between 0 and 59, false) as dv,
  coalesce(aw is not null and ac // 100 between 0 and 23 and ac % 100 between 0 and 59, false) as av
 from hh2)""")
    parts.append("""hh4 as (
 select *,
  case when dv then cast(FL_DATE as timestamp) + to_days(case when dw = 2400 then 1 else 0 end)
       + to_minutes(cast((dc // 100) * 60 + dc % 100 as bigint)) end as dep_ts,
  case when av then cast(FL_DATE as timestamp) + to_days(case when aw = 2400 then 1 else 0 end)
       + to_minutes(cast((ac // 100) * 60 + ac % 100 as bigint)) end as arr_ts0
 from hh3)""")
    parts.append(f"""clean as (
 select {idl}, TAIL_NUM, FL_DATE, OP_UNIQUE_CARRIER, ORIGIN, DEST, CRS_DEP_TIME, CRS_ARR_TIME,
  DEP_DELAY, ARR_DELAY, DISTANCE, CANCELLED, DIVERTED,
  cast(case when dv then dc // 100 end as integer) as sched_dep_hour,
  cast(case when av then ac // 100 end as integer) as sched_arr_hour,
  cast(month(FL_DATE) as integer) as month, cast(isodow(FL_DATE) as integer) as day_of_week,
  ORIGIN || '-' || DEST as route,
  dep_ts as sched_dep_timestamp,
  case when dep_ts is not null and arr_ts0 is not null and arr_ts0 < dep_ts
       then arr_ts0 + interval 1 day else arr_ts0 end as sched_arr_timestamp
 from hh4)""")
    if upto in ("cand", "pairs", "mf"):
        order = ", ".join(ids)
        parts.append(f"""lagged as (
 select *,
  lag(ORIGIN) over w as prev_ORIGIN, lag(DEST) over w as prev_DEST, lag(route) over w as prev_route,
  lag(ARR_DELAY) over w as prev_ARR_DELAY, lag(DEP_DELAY) over w as prev_DEP_DELAY,
  lag(DISTANCE) over w as prev_DISTANCE, lag(sched_arr_timestamp) over w as prev_sched_arr_timestamp
 from clean
 window w as (partition by TAIL_NUM order by sched_dep_timestamp asc nulls last, {order}))""")
        parts.append(f"""cand as (
 select {idl}, TAIL_NUM, OP_UNIQUE_CARRIER, FL_DATE as current_FL_DATE,
  ORIGIN as current_ORIGIN, DEST as current_DEST, route as current_route,
  sched_dep_hour as current_sched_dep_hour, DEP_DELAY as current_DEP_DELAY,
  ARR_DELAY as current_ARR_DELAY, DISTANCE as current_DISTANCE,
  prev_ORIGIN, prev_DEST, prev_route, prev_ARR_DELAY, prev_DEP_DELAY, prev_DISTANCE,
  prev_sched_arr_timestamp, sched_dep_timestamp as current_sched_dep_timestamp,
  cast(date_diff('second', prev_sched_arr_timestamp, sched_dep_timestamp) as double) / 60.0
    as scheduled_turnaround_minutes,
  cast(coalesce(prev_DEST = ORIGIN, false) as integer) as same_airport_connection,
  cast(coalesce(DEP_DELAY > 15, false) as integer) as current_dep_delayed_15,
  cast(coalesce(prev_ARR_DELAY > 15, false) as integer) as prev_arr_delayed_15
 from lagged)""")
    if upto in ("pairs", "mf"):
        parts.append("""pairs as (
 select * from cand
 where same_airport_connection = 1 and scheduled_turnaround_minutes between 20 and 600)""")
    if upto == "mf":
        parts.append("""mf0 as (
 select {idl}, TAIL_NUM, OP_UNIQUE_CARRIER, current_DEP_DELAY, prev_ARR_DELAY,
  scheduled_turnaround_minutes, cast(current_sched_dep_hour as double) as current_sched_dep_hour,
  current_DISTANCE, current_dep_delayed_15,
  cast(year(current_FL_DATE) as integer) as current_year,
  cast(month(current_FL_DATE) as integer) as current_month,
  cast(isodow(current_FL_DATE) as integer) as current_day_of_week,
  case when scheduled_turnaround_minutes >= 20 and scheduled_turnaround_minutes < 45 then '20-44'
       when scheduled_turnaround_minutes >= 45 and scheduled_turnaround_minutes < 90 then '45-89'
       when scheduled_turnaround_minutes >= 90 and scheduled_turnaround_minutes < 180 then '90-179'
       when scheduled_turnaround_minutes >= 180 and scheduled_turnaround_minutes <= 600 then '180-600'
  end as turnaround_bin,
  case when current_sched_dep_hour between 0 and 5 then 'overnight'
       when current_sched_dep_hour between 6 and 11 then 'morning'
       when current_sched_dep_hour between 12 and 17 then 'afternoon'
       when current_sched_dep_hour between 18 and 23 then 'evening' end as dep_period
 from pairs)""".replace("{idl}", idl))
        parts.append("""mf as (
 select * from mf0
 where current_DEP_DELAY is not null and prev_ARR_DELAY is not null
   and scheduled_turnaround_minutes is not null and current_sched_dep_hour is not null
   and current_DISTANCE is not null and OP_UNIQUE_CARRIER is not null
   and current_dep_delayed_15 is not null and current_year is not null
   and current_month is not null and current_day_of_week is not null
   and turnaround_bin is not null and dep_period is not null)""")
    return "with " + ",\n".join(parts) + "\n"
