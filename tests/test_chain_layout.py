"""Data-driven chain buckets, the co-located layout, and months added one by one."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.operators import append as AP
from knockon.operators import chain as CH
from knockon.operators import decay as D
from knockon.operators import pairs as P
from knockon.plans import catalog as K
from knockon.session import materialize, scratch_path
from knockon.sources import layout as L

ORDER = P.chain_order(["event_id"])


def rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def chains(df, split):
    prev = CH.chain_links(df, "e", ["t", "k"], prev_cols=["k", "v"], split=split, position=True)
    lead = CH.chain_links(df, "e", ["t", "k"], lead_col="v", max_lead=3, split=split)
    return (rows(prev, ["e", "k", "_prev", "_pos"]), rows(lead, ["e", "k", "_next_1", "_next_2", "_next_3"]))


@pytest.fixture(scope="module")
def skewed(spark):
    """One entity with half of a day's rows (many at one instant), one with 60,000 rows without a time."""
    usual = spark.range(60_000).select(F.concat(F.lit("u"), F.col("id") % 300).alias("e"), F.col("id").alias("k"),
                                       (F.col("id") * 37 % 86_400).alias("t"))
    hot = spark.range(60_000, 120_000).select(F.lit("hot").alias("e"), F.col("id").alias("k"), F.when(
        F.col("id") % 2 == 0, F.lit(600)).otherwise(F.col("id") * 7 % 86_400).alias("t"))
    timeless = spark.range(120_000, 180_000).select(F.lit("none").alias("e"), F.concat(
        F.lit("x"), F.col("id") * 7919 % 60_000).alias("text"), F.col("id").alias("k"), F.lit(None).cast("long").alias("t"))
    table = usual.unionByName(hot).unionByName(timeless.drop("text")).withColumns(
        {"t": F.timestamp_seconds("t").cast("timestamp_ntz"), "v": F.col("k") * 3 % 1001})
    return materialize(table.repartition(7, F.xxhash64("k")), "skewed")


def test_hot_entities_are_cut_by_their_own_quantiles(spark, skewed, monkeypatch):
    monkeypatch.setattr(CH, "LEAST_ROWS", 2_000)
    bounds = CH.hot_bounds(skewed, "e", ["t", "k"], 4_000)
    assert {r.e for r in bounds.collect()} == {"hot", "none"}
    sizes = sorted(r["count"] for r in CH.with_bucket(skewed, "e", ["t", "k"], bounds)
                   .where("e in ('hot', 'none')").groupBy("e", CH.BK).count().collect())
    assert len(sizes) > 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_cut_chains_equal_the_plain_window(skewed, monkeypatch):
    monkeypatch.setattr(CH, "LEAST_ROWS", 2_000)
    assert CH.bucket_rows(skewed) == 180_000 // 16
    assert chains(skewed, "auto") == chains(skewed, None)


def test_text_tie_breaks_and_null_keys(spark):
    data = [("a", None, f"k{i % 50:02d}", i) for i in range(200)] + [("b", None, None, 7), (None, None, "z", 1)]
    df = materialize(spark.createDataFrame(data, "e string, t timestamp_ntz, k string, v long"), "ties")
    bounds = CH.hot_bounds(df, "e", ["t", "k"], 20)
    placed = CH.with_bucket(df, "e", ["t", "k"], bounds)
    assert placed.count() == len(data) and placed.where("e = 'a'").select(CH.BK).distinct().count() >= 2
    wrong = placed.alias("x").join(placed.alias("y"), F.expr(
        f"x.e = y.e and x.k < y.k and x.{CH.BK} > y.{CH.BK}")).count()
    assert wrong == 0


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_layout_needs_no_exchange(spark, sf_dir):
    clean = materialize(K.clean_of(spark, sf_dir), "clean")
    path = scratch_path(spark, "layout")
    laid = L.write_chain_layout(clean, path, "flights_by_tail", ORDER, files=4)
    pairs = P.flight_pairs(laid, ["event_id"], split=L.BUCKET, keep=["event_id"])
    rows_branch = plan_of(pairs).split("BroadcastExchange")[0]
    assert "Exchange hash" not in rows_branch and "Bucketed: true" in rows_branch
    whole = P.flight_pairs(clean, ["event_id"], split=None, keep=["event_id"])
    cols = ["event_id", *S.PAIR_COLUMNS]
    assert rows(pairs, cols) == rows(whole, cols)
    legs = [f"next_dep_delay_{k}" for k in range(1, 6)]
    assert rows(D.later_legs(laid, 5, ["event_id"], split=L.BUCKET), ["event_id", *legs]) == rows(
        D.later_legs(clean, 5, ["event_id"], split=None), ["event_id", *legs])

    hot = L.write_chain_layout(clean, scratch_path(spark, "layout"), "flights_by_tail_cut", ORDER, 4, bucket_rows=20)
    assert hot.select(L.BUCKET).distinct().count() > 2
    cut = P.flight_pairs(hot, ["event_id"], split=L.BUCKET, keep=["event_id"])
    assert "Exchange hash" not in plan_of(cut).split("BroadcastExchange")[0]
    assert rows(cut, cols) == rows(whole, cols)
    again = L.open_chain_layout(spark, path, "flights_by_tail_again", ORDER, 4)
    pairs = P.flight_pairs(again, ["event_id"], split=L.BUCKET, keep=["event_id"])
    assert "Exchange hash" not in plan_of(pairs).split("BroadcastExchange")[0]
    assert rows(pairs, cols) == rows(whole, cols)
    with pytest.raises(ValueError):
        L.open_chain_layout(spark, path, "a; drop table b", ORDER, 4)


def test_months_one_by_one_equal_the_rebuild(spark, sf_dir, tmp_path):
    clean = materialize(K.clean_of(spark, sf_dir).withColumn("day", F.dayofmonth("FL_DATE")), "clean")
    parts = {"2024-01": "day <= 9", "2024-02": "day between 10 and 17", "2024-03": "day > 17"}
    store = AP.PairStore(spark, f"{tmp_path}/store", ["event_id"], ["event_id"])
    with pytest.raises(ValueError):
        store.pairs()
    cols = ["event_id", *S.PAIR_COLUMNS]
    for month, part in parts.items():
        added = store.add(month, clean.where(part))
        assert added.columns == cols
    assert store.months() == list(parts)
    want = rows(P.flight_pairs(clean, ["event_id"], split=None, keep=["event_id"]), cols)
    assert rows(store.pairs(), cols) == want
    store.add("2024-03", clean.where(parts["2024-03"]))  # again: replaced, not doubled
    assert rows(store.pairs(), cols) == want
    with pytest.raises(AP.LateFlightsError, match="2024-02"):
        store.add("2024-02", clean.where(parts["2024-02"]))
    with pytest.raises(AP.LateFlightsError, match=r"flights of \d+ tails") as late:
        store.add("2024-04", clean.where("day = 12"))
    assert re.search(r"from \d{4}-\d\d-\d\d", str(late.value))
    assert store.months() == list(parts)
    assert store.add("2024-05", clean.where("false")).count() == 0
