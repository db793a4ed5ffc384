"""Flight-shaped input views over the driver tables.

``fx_flights`` (one month, dirty rows, over ``events``; row id ``event_id``) and
``fx_lineitem_flights`` (seven years, clean, over ``lineitem``; row id
``l_orderkey, l_linenumber, l_partkey, l_extendedprice``).  The SQL is portable:
Spark runs it here and the DuckDB oracle runs the same text, so both engines
start from identical raw rows.  Work grows with the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_FLIGHTS_SQL = """
with b as (
 select event_id, user_id, ts, event_type, value,
  lag(event_id) over w as pe, coalesce(lag(value,1) over w,0.0) v1,
  coalesce(lag(value,2) over w,0.0) v2, coalesce(lag(value,3) over w,0.0) v3,
  hour(ts)*60+minute(ts) as m0
 from events window w as (partition by user_id order by ts, event_id)),
c as (select *, (m0 + 20 + event_id % 70) % 1440 as m1,
  cast(floor(value + 0.6*v1 + 0.36*v2 + 0.216*v3) as int) - 60 as d0 from b)
select event_id,
 case when event_id % 97 = 0 then null when event_id % 101 = 0 then '  '
      else concat(' N', cast(user_id as varchar(20)), ' ') end as TAIL_NUM,
 cast(cast(ts as date) as varchar(20)) as FL_DATE,
 event_type as OP_UNIQUE_CARRIER,
 concat('S', cast((coalesce(pe,0) + case when event_id % 8 = 0 then 1 else 0 end) % 5 as varchar(20))) as ORIGIN,
 concat('S', cast(event_id % 5 as varchar(20))) as DEST,
 case when event_id % 79 = 0 then null when event_id % 61 = 0 then 1275 when event_id % 73 = 0 then 2400
      else cast(floor(m0/60) as int)*100 + m0 % 60 end as CRS_DEP_TIME,
 case when event_id % 83 = 0 then null else cast(floor(m1/60) as int)*100 + m1 % 60 end as CRS_ARR_TIME,
 case when event_id % 53 = 0 then null else d0 end as DEP_DELAY,
 case when event_id % 59 = 0 then null else d0 + event_id % 11 - 5 end as ARR_DELAY,
 100 + (event_id % 50)*40 as DISTANCE,
 case when event_id % 43 = 0 then 1 else 0 end as CANCELLED,
 case when event_id % 47 = 0 then 1 else 0 end as DIVERTED
from c
"""

FX_LINEITEM_FLIGHTS_SQL = """
with a as (
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  cast(date_trunc('month', l_shipdate) as date) as mon,
  cast((l_orderkey*37 + l_linenumber*211 + l_partkey*13) % 1440 as int) as m0,
  l_orderkey*7 + l_linenumber*3 + l_partkey as h
 from lineitem),
b as (
 select a.*, lag(h) over w as ph,
  coalesce(lag(l_quantity,1) over w,0.0) as v1, coalesce(lag(l_quantity,2) over w,0.0) as v2
 from a window w as (partition by l_suppkey
   order by mon, m0, l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
c as (select b.*, cast((m0 + 20 + h % 70) % 1440 as int) as m1,
  cast(floor(l_quantity + 0.6*v1 + 0.36*v2) as int) - 45 as d0 from b)
select h as row_key, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
 concat('N', cast(l_suppkey as varchar(20))) as TAIL_NUM,
 concat(substr(cast(mon as varchar(20)),1,8), lpad(cast(1 + l_suppkey % 27 as varchar(20)),2,'0')) as FL_DATE,
 concat('C', cast(l_suppkey % 7 as varchar(20))) as OP_UNIQUE_CARRIER,
 concat('S', cast((coalesce(ph,0) + case when h % 8 = 0 then 1 else 0 end) % 5 as varchar(20))) as ORIGIN,
 concat('S', cast(h % 5 as varchar(20))) as DEST,
 cast(floor(m0/60)*100 + m0 % 60 as int) as CRS_DEP_TIME,
 cast(floor(m1/60)*100 + m1 % 60 as int) as CRS_ARR_TIME,
 case when h % 53 = 0 then null else d0 end as DEP_DELAY,
 case when h % 59 = 0 then null else cast(d0 + h % 11 - 5 as int) end as ARR_DELAY,
 cast(100 + (l_partkey % 50)*40 as int) as DISTANCE,
 case when h % 43 = 0 then 1 else 0 end as CANCELLED,
 case when h % 47 = 0 then 1 else 0 end as DIVERTED
from c
"""

FX_FLIGHTS_ORDER = ["event_id"]
FX_LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=("events", "lineitem")) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def fx_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw monthly flights (dirty: null/blank/padded tails, 1275/2400 clocks, nulls)."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(FX_FLIGHTS_SQL)


def fx_lineitem_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flights over seven years (tail = supplier)."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(FX_LINEITEM_FLIGHTS_SQL)
