"""Entity chains: previous / next rows of the same entity in event order.

The plain form is ``Window.partitionBy(entity).orderBy(time, tiebreak)``, which
sends all rows of one entity to one task.  That is right for entities of a usual
size, and wrong for a hot one, which would serialise the job on one sort.

The buckets of a hot entity come from its own rows (``split="auto"``).  One
count per entity finds the entities with more rows than a task should have; for
those, quantiles of the whole order key - time, then every tie-break, nulls
last - are read off a sample that is taken by a hash of the key, and cut the
entity into buckets of about equal size.  Rows that share a day, an instant, or
have no time at all are split like any others, because the key goes on to the
tie-breaks.  Other entities stay whole, so they need no stitch.

Windows then run per (entity, bucket), and the edges of a hot entity's buckets
are stitched:

* the first row of a bucket takes its previous row from the last row of the
  bucket before;
* the last ``k`` rows of a bucket take their next ``k`` rows from the heads
  (first ``k`` rows) of the buckets after it.

The stitch table has one row per hot bucket, so it is bounded by the number of
tasks, not by the row count or the time span.  "day" and "hour" buckets remain
for callers that want fixed ones; they stitch every entity.

A table laid out by ``sources.layout`` carries its bucket as a column and is
bucketed by (entity, bucket): ``split`` names that column, and the row branch
of the chain then reads the table without any exchange.

The input is read by two branches (rows and stitch table), so callers pass a
materialised table (the written clean flights), not a long lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knockon.session import materialize

BK = "_chain_bucket"
#: Rows without an event time come after every bucket, in buckets of their tie-break.
_NULL_BUCKET = 2 ** 62
NULL_SPAN = 100_000
#: An entity is hot beyond half a task's share of the rows, within these limits.
LEAST_ROWS, MOST_ROWS = 10_000, 2_000_000
#: Sampled rows per bucket that place its bounds.
SAMPLES = 64


def order_key(order: list[str]) -> Column:
    """The order columns as one comparable value with nulls last."""
    return F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in order])


def bucket_rows(df: DataFrame) -> int:
    """Rows that a bucket should have: half of what a shuffle partition gets on average."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_ROWS, min(MOST_ROWS, df.count() // (2 * tasks)))


def hot_bounds(df: DataFrame, entity: str, order: list[str], rows: int | None = None) -> DataFrame | None:
    """(entity, bounds): the order keys at which buckets of the hot entities begin; None if no entity is hot.

    At most 2 x all rows / ``rows`` keys in all, whatever the entities are.  The
    sample only places the bounds: any bounds give the same chains.
    """
    rows = rows or bucket_rows(df)
    counts = materialize(df.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows)
                         .where(F.col(entity).isNotNull()), "chain-hot")
    if counts.isEmpty():
        return None
    place = F.pmod(F.xxhash64(F.lit(entity), *[F.col(c) for c in order]), F.lit(1 << 30))
    share = F.lit(SAMPLES) * F.ceil(F.col("_rows") / rows) / F.col("_rows") * (1 << 30)
    picked = (df.select(entity, *order).join(F.broadcast(counts), entity).where(place < share)
              .select(entity, order_key(order).alias("key")))
    bounds = picked.groupBy(entity).agg(F.sort_array(F.collect_list("key")).alias("keys")).select(entity, F.array_distinct(
        F.filter("keys", lambda k, i: (i > 0) & (i % SAMPLES == 0))).alias("_bounds"))
    return materialize(bounds.where(F.size("_bounds") > 0), "chain-bounds")


def _place(bounds: Column, key: Column, steps: int) -> Column:
    """Number of bounds that are not above the key, by bisection of the sorted array."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at.lo + at.hi) / 2).cast("int")
        below = (at.lo < at.hi) & (F.get(bounds, mid) <= key)
        return F.struct(F.when(below, mid + 1).otherwise(at.lo).alias("lo"),
                        F.when((at.lo < at.hi) & ~below, mid).otherwise(at.hi).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda at: at.lo)


def with_bucket(df: DataFrame, entity: str, order: list[str], bounds: DataFrame | None, column: str = BK) -> DataFrame:
    """``df`` with its chain bucket: 0 for entities that stay whole, from 1 on in order for hot ones."""
    if bounds is None:
        return df.withColumn(column, F.lit(0))
    most = bounds.agg(F.max(F.size("_bounds"))).first()[0] or 1
    place = _place(F.col("_bounds"), order_key(order), most.bit_length() + 1)
    return (df.join(F.broadcast(bounds), entity, "left")  # bounded: see hot_bounds
            .withColumn(column, F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(place + 1)).drop("_bounds"))


def _bucket_expr(df: DataFrame, order: list[str], split) -> Column:
    """Bucket number of a fixed split, rising with the order.

    Rows without a time have only the tie-break: a whole-number one is cut into
    spans, so that they do not all meet in one bucket.
    """
    time = F.col(order[0])
    if isinstance(split, Column):
        expr = split
    elif split == "day":
        expr = F.unix_date(time.cast("date")).cast("long")
    elif split == "hour":
        expr = F.floor(F.unix_seconds(time.cast("timestamp")) / 3600).cast("long")
    else:
        raise ValueError(f"unknown split {split!r}")
    late = F.lit(_NULL_BUCKET).cast("long")
    if len(order) > 1 and df.schema[order[1]].dataType.simpleString() in ("int", "bigint", "smallint"):
        late = late + F.coalesce(F.floor(F.col(order[1]) / NULL_SPAN).cast("long"), F.lit(2 ** 60).cast("long"))
    return F.coalesce(expr, late)


def previous(column: str) -> str:
    """The column of ``chain_links`` with the previous row's value of ``column``."""
    return f"_previous_{column}"


def _prev_struct(first: Column, prev_cols) -> Column:
    """The previous row's values as one struct, null for the first row of an entity."""
    return F.when(~first, F.struct(*[F.col(previous(c)).alias(c) for c in prev_cols]))


def _whole(df: DataFrame, entity: str, ordering: list, prev_cols, lead_col, max_lead: int,
           position: bool) -> DataFrame:
    """The chain with one window partition per entity."""
    w = Window.partitionBy(entity).orderBy(*ordering)
    added = {previous(c): F.lag(c, 1).over(w) for c in prev_cols}
    added |= {f"_next_{k}": F.lead(lead_col, k).over(w) for k in range(1, max_lead + 1)}
    out = df.withColumns(added | {"_pos": F.row_number().over(w).cast("long")})
    out = out.withColumn("_prev", _prev_struct(F.col("_pos") == 1, prev_cols))
    return out if position else out.drop("_pos")


def chain_links(df: DataFrame, entity: str, order: list[str], prev_cols=(), lead_col=None,
                max_lead: int = 0, split="auto", position: bool = False) -> DataFrame:
    """Add ``_prev`` (struct of ``prev_cols`` of the previous row, null for the first
    row of an entity), the same values as columns (``previous``) and
    ``_next_1.._next_k`` (``lead_col`` k rows later); with ``position`` also ``_pos``, the 1-based place of the row in its entity's chain
    (bucket sizes prefix-summed over the stitch table plus the rank in the bucket).

    ``order[0]`` is the event time (ascending, nulls last); the rest break ties.
    ``split`` is "auto" (hot entities by their own quantiles), "day", "hour", a
    Column monotone in ``order[0]``, the name of a bucket column of ``df`` (a laid
    out table), or None (one window partition per entity).

    Each column is lagged by itself: a lagged struct would travel through the
    shuffle and the sort beside the columns it is made of, and Spark cannot leave
    out the fields that nobody reads.
    """
    ordering = [F.col(c).asc_nulls_last() for c in order]
    payload = F.struct(*[F.col(c).alias(c) for c in prev_cols])
    hot_only = True
    if split == "auto":
        bounds = hot_bounds(df, entity, order)
        if bounds is None:
            return _whole(df, entity, ordering, prev_cols, lead_col, max_lead, position)
        df, bk = with_bucket(df, entity, order, bounds), BK
    elif split is None:
        return _whole(df, entity, ordering, prev_cols, lead_col, max_lead, position)
    elif isinstance(split, str) and split in df.columns:
        bk = split
    else:
        df, bk, hot_only = df.withColumn(BK, _bucket_expr(df, order, split)), BK, False

    w = Window.partitionBy(entity, bk).orderBy(*ordering)
    w_all = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (df.withColumns({f"_lag_{c}": F.lag(c, 1).over(w) for c in prev_cols})
              .withColumn("_rn", F.row_number().over(w))
              .withColumn("_n", F.count(F.lit(1)).over(w_all).cast("int")))
    for k in range(1, max_lead + 1):
        rows = rows.withColumn(f"_ld_{k}", F.lead(lead_col, k).over(w))

    # Stitch table: per (entity, bucket) the last row's payload (and, for leads, the
    # first k lead values).
    split_rows = F.col(bk) > 0 if hot_only else F.lit(True)
    if max_lead:
        edge = rows.where(split_rows & ((F.col("_rn") == F.col("_n")) | (F.col("_rn") <= max_lead)))
        summ = edge.groupBy(entity, bk).agg(
            F.max_by(payload, F.col("_rn")).alias("_last"), F.max("_n").alias("_cnt"),
            F.sort_array(F.collect_list(F.when(
                F.col("_rn") <= max_lead,
                F.struct(F.col("_rn").alias("rn"), F.col(lead_col).alias("v"))))).alias("_head"))
    else:
        # Lag only: the last row per bucket is a partial (map-side) aggregation of the
        # input itself, so this branch shuffles one small row per bucket per task and
        # does not recompute the window.
        summ = df.where(split_rows).groupBy(entity, bk).agg(
            F.max_by(payload, order_key(order)).alias("_last"), F.count(F.lit(1)).alias("_cnt"))
    ws = Window.partitionBy(entity).orderBy(bk)
    link_cols = [F.col(entity), F.col(bk), F.lag("_last", 1).over(ws).alias("_prev_last")]
    if max_lead:
        link_cols.append(F.transform(
            F.flatten(F.collect_list("_head").over(ws.rowsBetween(1, max_lead))),
            lambda s: s["v"]).alias("_next_heads"))
    if position:
        link_cols.append(F.coalesce(F.sum("_cnt").over(
            ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_before"))
    links = summ.select(*link_cols)
    if hot_only:
        links = F.broadcast(links)  # one row per bucket of a hot entity: bounded like the bounds

    out = rows.join(links, on=[entity, bk], how="left")
    starts = F.col("_rn") == 1
    out = out.withColumns({previous(c): F.when(starts, F.col("_prev_last")[c]).otherwise(F.col(f"_lag_{c}"))
                           for c in prev_cols})
    out = out.withColumn("_prev", _prev_struct(starts & F.col("_prev_last").isNull(), prev_cols))
    for k in range(1, max_lead + 1):
        out = out.withColumn(
            f"_next_{k}",
            F.when(F.col("_rn") + k <= F.col("_n"), F.col(f"_ld_{k}")).otherwise(
                F.try_element_at(F.col("_next_heads"), (F.col("_rn") + k - F.col("_n")).cast("int"))))
    if position:
        out = out.withColumn("_pos", F.coalesce(F.col("_before"), F.lit(0)) + F.col("_rn")).drop("_before")
    drop = ["_rn", "_n", "_prev_last", *[f"_lag_{c}" for c in prev_cols], *[f"_ld_{k}" for k in range(1, max_lead + 1)]]
    if bk == BK:
        drop.append(BK)
    if max_lead:
        drop.append("_next_heads")
    return out.drop(*drop)
