"""Counts and guards from the pass that writes."""

import pytest
from pyspark.sql import functions as F

from knockon.operators import clean as C
from knockon.operators import pairs as P
from knockon.sources import counted as CO
from knockon.sources import fixtures as FX

SMALL = "/root/testdata/sf0.001"


def test_clean_rows_and_counts_equal_the_separate_jobs(spark, tmp_path):
    raw = FX.fx_flights(spark, SMALL)
    keep = FX.FX_FLIGHTS_ORDER
    counts = CO.write_clean(raw, f"{tmp_path}/clean", keep=keep)
    want = C.clean_summary(raw, keep=keep).first().asDict()
    got = CO.clean_summary(spark, f"{tmp_path}/clean", counts).first().asDict()
    assert got == want
    clean = C.clean_flights(raw, keep=keep)
    back = spark.read.parquet(f"{tmp_path}/clean").select(*clean.columns)
    assert back.exceptAll(clean).count() == 0 and clean.exceptAll(back).count() == 0


def test_pairs_and_counts_equal_the_separate_jobs(spark, tmp_path):
    keep = FX.FX_FLIGHTS_ORDER
    clean = C.clean_flights(FX.fx_flights(spark, SMALL), keep=keep)
    counts = CO.write_pairs(clean, f"{tmp_path}/pairs", tiebreak=keep, keep=keep)
    assert counts == P.pair_summary(clean, tiebreak=keep).first().asDict()
    pairs = P.flight_pairs(clean, tiebreak=keep, keep=keep)
    back = spark.read.parquet(f"{tmp_path}/pairs").select(*pairs.columns)
    assert back.exceptAll(pairs).count() == 0 and pairs.exceptAll(back).count() == 0


@pytest.mark.parametrize("none", ["false", "event_id < -1"])
def test_no_rows_count_as_zero_and_fail_the_guard(spark, tmp_path, none):
    raw = FX.fx_flights(spark, SMALL).where(none)
    counts = CO.write_clean(raw, f"{tmp_path}/clean", keep=FX.FX_FLIGHTS_ORDER)
    assert set(counts.values()) == {0}
    assert CO.clean_summary(spark, f"{tmp_path}/clean", counts).first().distinct_tail_numbers == 0
    with pytest.raises(CO.TooFewRowsError, match="output_rows: 1 needed, 0 found"):
        CO.require_rows(counts, "output_rows")


def test_counts_are_taken_behind_the_last_exchange(spark, tmp_path):
    """The one observation sits above the exchange, so a rerun map task adds nothing."""
    typed = C.coerce_types(FX.fx_flights(spark, SMALL)).withColumn("_year", F.year("FL_DATE"))
    seen = typed.hint("rebalance", "_year").observe("n", F.count(F.lit(1)).alias("n")).where("CANCELLED = 0")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.index("CollectMetrics") < plan.index("Exchange")


def test_missing_columns_of_each_header(spark, tmp_path):
    header = [names[0] for names in C.S.COLUMN_ALIASES.values()]
    for name, lacking in (("a", []), ("b", ["TAIL_NUM"])):
        left = [h for h, c in zip(header, C.S.COLUMN_ALIASES) if c not in lacking]
        (tmp_path / f"{name}.csv").write_text(",".join(left) + "\n")
    got = {r.path[-5:]: r.missing for r in CO.missing_columns(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": [], "b.csv": ["TAIL_NUM"]}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        CO.missing_columns(spark, f"{tmp_path}/empty")
