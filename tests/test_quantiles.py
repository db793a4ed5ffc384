"""Exact quantiles by selection against NumPy, with zones small enough that rounds happen."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from knockon.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"x": np.asarray(values, float)})).repartition(8)


def same(spark, values, small=50):
    got = exact_quantiles(frame(spark, values), "x", PROBS, small=small)
    assert np.allclose(got, np.quantile(values, PROBS), rtol=1e-12, atol=0)


def test_distinct_values_of_any_scale(spark):
    draw = np.random.default_rng(1)
    same(spark, np.exp(draw.normal(0, 20, 30_000)))
    same(spark, np.concatenate([draw.normal(0, 1, 5_000), [-1e300, 1e300, 0.0]]))


def test_ties_fill_a_zone(spark):
    draw = np.random.default_rng(2)
    same(spark, draw.integers(0, 3, 20_000))
    same(spark, np.full(5_000, 7.5))
    same(spark, np.concatenate([np.zeros(9_000), np.ones(11_000), [0.5]]))


def test_many_distinct_values_with_the_default_zone(spark):
    """A million distinct doubles: the rounds run with the zone that a user gets."""
    df = spark.range(1_000_000).select((F.xxhash64("id") / F.lit(2.0 ** 40)).alias("x"))
    want = df.agg(F.percentile("x", [0.01, 0.5, 0.99])).first()[0]
    assert np.allclose(exact_quantiles(df, "x", [0.01, 0.5, 0.99]), want, rtol=1e-12, atol=0)


def test_edges(spark):
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, "x", [0.5]) == [None]
    odd = spark.createDataFrame([(None,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(odd, "x", [0.0, 0.5, 1.0]) == [3.0, 3.0, 3.0]
    assert exact_quantiles(frame(spark, [float("-inf"), 1.0, float("inf")]), "x", [0.0, 0.5, 1.0]) == [
        float("-inf"), 1.0, float("inf")]
    with pytest.raises(ValueError):
        exact_quantiles(empty, "x", [1.5])
