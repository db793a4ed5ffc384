"""Logit fits with levels that separate the outcomes, and with steps that overshoot."""

import numpy as np
import pytest

from knockon.operators import grouped as G
from knockon.operators import models as M
from knockon.plans import suite as SU
from knockon.session import materialize

COLUMNS = ("TAIL_NUM string, OP_UNIQUE_CARRIER string, current_DEP_DELAY double, prev_ARR_DELAY double, "
           "scheduled_turnaround_minutes double, current_sched_dep_hour int, current_DISTANCE double, current_dep_delayed_15 int, "
           "prev_arr_delayed_15 int, current_year int, current_month int, current_day_of_week int, "
           "turnaround_bin string, dep_period string")


def frame(spark, carriers, n=1500, seed=1):
    """Carrier -> (intercept, slope); None is a carrier that is never late."""
    draw = np.random.default_rng(seed)
    rows = []
    for carrier, line in carriers.items():
        for i in range(n):
            prev = float(draw.normal(5, 20))
            late = 0 if line is None else int(draw.random() < 1 / (1 + np.exp(-line[0] - line[1] * prev)))
            rows.append((f"N{i % 40}", carrier, 30.0 * late, prev, 60.0, 9, 500.0, late, int(prev > 15), 2024, 1 + i % 2,
                         1 + i % 3, "20-60" if i % 2 else "60-120", "morning"))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = frame(spark, {"AA": (-1.0, 0.03), "BB": (-0.5, 0.06), "CC": None, "DD": (-1.5, 0.01)})
    return materialize(spark.createDataFrame(rows, COLUMNS), "separated")


def test_a_separated_carrier_keeps_its_row_and_spares_the_others(spark, table):
    options = {"models": ("linear", "logistic", "airline"), "factors": [], "numerics": []}
    out = SU.fit_suite(spark, table, **options)
    assert [tuple(r) for r in out["separated"].collect()] == [("OP_UNIQUE_CARRIER", "CC", 1500, 0)]
    got = {r.airline: r for r in out["airline_carryover"].collect()}
    assert got["CC"].carryover_log_odds_per_1_min is None and got["CC"].n_obs == 1500
    alone = SU.fit_suite(spark, table.where("OP_UNIQUE_CARRIER <> 'CC'"), **options)
    assert alone["separated"].count() == 0
    for r in alone["airline_carryover"].collect():
        assert abs(got[r.airline].carryover_log_odds_per_1_min - r.carryover_log_odds_per_1_min) < 1e-9
        assert abs(got[r.airline].std_err - r.std_err) < 1e-9
    assert out["main_result"].count() == 1 and {r.converged for r in out["metrics"].collect()} == {True}
    linear = out["coefficients"].where("model = 'linear'").collect()
    assert len(linear) == 2 and all(r.estimate is not None for r in linear)  # all carriers


def test_separation_spreads_until_none_is_left(spark):
    rows = [("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "x", 0), ("c", "y", 0), ("c", "z", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "f string, g string, current_dep_delayed_15 int")
    found = G.separated_levels(df, ["f", "g"])
    assert {x[:2] for x in found} >= {("f", "b"), ("g", "z")}
    left = G.without_levels(df, found)
    assert G.separated_levels(left, ["f", "g"]) == []


def test_a_fit_without_a_maximum_is_reported(spark, table):
    """The previous delay itself separates: no level is at fault, the fit says so."""
    from pyspark.sql import functions as F
    df = table.withColumn("current_dep_delayed_15", (F.col("prev_ARR_DELAY") > 0).cast("int"))
    out = SU.fit_suite(spark, df, models=("linear", "logistic"), factors=[], numerics=[])
    assert {(r.model, r.converged) for r in out["metrics"].collect()} == {("linear", True), ("logistic", False)}
    main = out["main_result"].first()
    assert main.linear_prev_arr_delay_coef is not None and main.logistic_prev_arr_delay_coef is None


def test_overshooting_steps_are_halved(spark):
    """Heavy-tailed regressors: plain Newton steps raise the deviance; halved ones reach the maximum."""
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(0, 1, 400), draw.normal(0, 60, 8)])
    y = (draw.random(408) < 1 / (1 + np.exp(3.0 - 2.5 * np.clip(x, -3, 3)))).astype(int)
    df = materialize(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "prev_ARR_DELAY double, "
                                           "current_dep_delayed_15 int"), "steps")
    design = M.build_design({}, [], [])
    fit = G.fit_logit(df, design)
    assert fit.metrics["converged"]
    X = np.column_stack([np.ones(len(x)), x])
    mu = 1 / (1 + np.exp(-X @ np.array(fit.estimates)))
    assert np.abs(X.T @ (y - mu)).max() < 1e-5
