"""A chain layout: clean flights stored so that chains read them without an exchange.

Rows are bucketed by (tail, chain bucket) and sorted in chain order, one file a
bucket.  Usual tails have chain bucket 0; a hot tail is cut at the quantiles of
its own rows (``operators.chain``), so no file holds a hot tail whole.  Writing
costs the one shuffle that every later chain then saves: pairs, later legs and
chain positions window the table where it lies.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from knockon.operators.chain import hot_bounds, with_bucket

ENTITY = "TAIL_NUM"
BUCKET = "chain_bucket"


def write_chain_layout(clean: DataFrame, path: str, table: str, order: list[str], files: int | None = None,
                       bucket_rows: int | None = None) -> DataFrame:
    """Store ``clean`` under ``path`` as the table ``table`` and return it.

    ``order`` is the chain order (time, then tie-breaks); ``files`` the number of
    buckets on disk (by default ``spark.sql.shuffle.partitions``).
    """
    spark = clean.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = with_bucket(clean, ENTITY, order, hot_bounds(clean, ENTITY, order, bucket_rows), BUCKET)
    (laid.repartition(files, ENTITY, BUCKET).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(files, ENTITY, BUCKET).sortBy(ENTITY, BUCKET, *order).saveAsTable(table))
    return spark.table(table)


def open_chain_layout(spark: SparkSession, path: str, table: str, order: list[str], files: int) -> DataFrame:
    """A layout written by another session, declared as ``table`` with the same buckets."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError(f"{table!r} is no table name")
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join([ENTITY, BUCKET])
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) "
              f"SORTED BY ({keys}, {', '.join(order)}) INTO {files} BUCKETS LOCATION '{location}'")
    return spark.table(table)
