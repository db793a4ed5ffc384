"""SURVEY §5 invariants and the hot-key case."""

from pyspark.sql import functions as F

from knockon.operators import decay as D
from knockon.operators import pairs as P
from knockon.operators.chain import _bucket_expr
from knockon.plans import catalog as K
from knockon.session import materialize


def test_decay_mean_is_pooled_mean(spark, sf_dir):
    clean = K.clean_of(spark, sf_dir)
    by_leg = {r.leg_index: r for r in D.decay_by_leg(D.tail_leg_summary(clean, tiebreak=["event_id"])).collect()}
    legs = D.shock_rows(D.later_legs(clean, 5, ["event_id"]))
    for k in range(1, 6):
        r = legs.agg(F.avg(f"next_dep_delay_{k}").alias("m"), F.count(f"next_dep_delay_{k}").alias("n")).first()
        assert by_leg[k].n_obs == r.n
        assert abs(by_leg[k].mean_remaining_delay - r.m) < 1e-9


def test_yearly_pairs_sum_to_total(spark, sf_dir):
    years = K.QUERIES["pairs_by_year"](spark, sf_dir).agg(F.sum("n_modeling_pairs")).first()[0]
    assert years == K.mf_of(spark, sf_dir).count()


def test_hot_tail_split_matches_and_spreads(spark, sf_dir):
    """One tail holding about a third of all flights: the day-split chain gives the same
    pairs as the plain per-tail window while its largest window partition shrinks."""
    clean = K.clean_of(spark, sf_dir, "lineitem")
    hot = materialize(clean.withColumn(
        "TAIL_NUM", F.when(F.col("OP_UNIQUE_CARRIER").isin("C0", "C1"), F.lit("HOT"))
        .otherwise(F.col("TAIL_NUM"))))
    share = hot.where("TAIL_NUM = 'HOT'").count() / hot.count()
    assert 0.2 < share < 0.45
    ids = K.ids("lineitem")
    cols = [*ids, "prev_ARR_DELAY", "prev_sched_arr_timestamp", "scheduled_turnaround_minutes"]
    plain = sorted(tuple(r) for r in P.pair_candidates(hot, ids, split=None, keep=ids).select(*cols).collect())
    split = sorted(tuple(r) for r in P.pair_candidates(hot, ids, split="day", keep=ids).select(*cols).collect())
    assert plain == split
    biggest_tail = hot.groupBy("TAIL_NUM").count().agg(F.max("count")).first()[0]
    biggest_bucket = (hot.groupBy("TAIL_NUM", _bucket_expr(hot, ["sched_dep_timestamp"], "day").alias("b"))
                      .count().agg(F.max("count")).first()[0])
    assert biggest_bucket * 20 < biggest_tail


def test_hot_tail_with_missing_times_splits_leads_and_positions(spark, sf_dir):
    """A third of the rows on one tail, many of them without a time: legs and positions equal the plain window."""
    clean = K.clean_of(spark, sf_dir)
    hot = materialize(clean.withColumn("TAIL_NUM", F.when(F.col("event_id") % 3 == 0, "HOT").otherwise(F.col("TAIL_NUM")))
                      .withColumn("sched_dep_timestamp", F.when(F.col("event_id") % 5 < 3, F.col("sched_dep_timestamp"))))
    cols = ["event_id"] + [f"next_dep_delay_{k}" for k in range(1, 6)]

    def legs(split):
        return sorted(tuple(r) for r in D.later_legs(hot, 5, ["event_id"], split=split).select(*cols).collect())

    def places(split):
        return sorted(tuple(r) for r in P.chain_sort(hot, ["event_id"], split=split).select(
            "event_id", "chain_position").collect())

    from unittest import mock

    from knockon.operators import chain
    plain = legs(None), places(None)
    for span in (100_000, 50):
        with mock.patch.object(chain, "NULL_SPAN", span):
            assert (legs("day"), places("day")) == plain
            largest = hot.groupBy("TAIL_NUM", _bucket_expr(hot, ["sched_dep_timestamp", "event_id"], "day").alias("b")).count()
            assert span > 50 or largest.agg(F.max("count")).first()[0] < 200


def test_large_partitions_are_written_in_several_files(spark, sf_dir, tmp_path):
    from knockon.sources import files
    clean = materialize(K.clean_of(spark, sf_dir, "lineitem"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        files.write_clean(clean, f"{tmp_path}/clean")
        files.write_tail_partitions(clean, f"{tmp_path}/tails", 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert spark.read.parquet(f"{tmp_path}/clean").count() == clean.count()
    buckets = spark.read.parquet(f"{tmp_path}/tails").select("partition_id", F.input_file_name().alias("f")).distinct()
    assert buckets.groupBy("partition_id").count().agg(F.min("count")).first()[0] > 1


def test_sample_is_the_same_with_and_without_the_bound(spark, sf_dir):
    from knockon.operators import reports as R
    mf = materialize(K.mf_of(spark, sf_dir))
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in K.ids("lineitem")], F.lit("42")))
    want = [tuple(r) for r in mf.orderBy(h).limit(200).select(*K.ids("lineitem")).collect()]
    got = [tuple(r) for r in R.sample_rows(mf, K.ids("lineitem"), 200).select(*K.ids("lineitem")).collect()]
    assert sorted(got) == sorted(want)


def test_density_counts_every_point(spark, sf_dir):
    from knockon.operators import reports as R
    mf = materialize(K.mf_of(spark, sf_dir))
    grid = R.density_grid(mf, "prev_ARR_DELAY", "current_DEP_DELAY")
    assert grid.agg(F.sum("count")).first()[0] == mf.count()


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from knockon import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
