"""Normal equations from cells of equal levels against the matrix of rows."""

import numpy as np
from pyspark.sql import functions as F

from knockon.operators import grouped as G
from knockon.operators import models as M
from knockon.plans import catalog as K


def by_rows(pdf, d):
    X = np.column_stack([np.ones(len(pdf))] + [pdf[f"x{i}"].to_numpy(float) for i in range(len(d.exprs))])
    return X, pdf.y.to_numpy(float)


def test_grams_equal_the_rows_and_stay_in_the_jvm(spark, sf_dir):
    mf = K.mf_of(spark, sf_dir, "lineitem").checkpoint(eager=True)
    factors = ["OP_UNIQUE_CARRIER", *M.CALENDAR_FACTORS]
    levels = M.factor_levels(mf, factors)
    for slope_by in (None, "OP_UNIQUE_CARRIER"):
        d = M.build_design(levels, factors, M.NUMERIC_CONTROLS, slope_by=slope_by)
        sums = G.gram_sums(mf, "current_year", d, "current_DEP_DELAY")
        plan = G.cell_sums(mf, "current_year", d, "current_DEP_DELAY")._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "Python" not in plan
        rows = mf.select("current_year", F.col("current_DEP_DELAY").alias("y"),
                         *[e.alias(f"x{i}") for i, e in enumerate(d.exprs)]).toPandas()
        assert set(sums) == {str(y) for y in rows.current_year.unique()}
        for year, part in rows.groupby("current_year"):
            X, y = by_rows(part, d)
            n, gram, moments, yy, sy = sums[str(year)]
            assert n == len(y)
            assert np.allclose(gram, X.T @ X, rtol=1e-9, atol=1e-6) and np.allclose(moments, X.T @ y, rtol=1e-9, atol=1e-6)
            assert np.isclose(yy, y @ y, rtol=1e-12) and np.isclose(sy, y.sum(), rtol=1e-9)


def test_packed_rows_become_the_same_matrix(spark, sf_dir):
    mf = K.mf_of(spark, sf_dir, "lineitem").limit(300).checkpoint(eager=True)
    levels = M.factor_levels(mf, ["dep_period", "current_month"])
    d = M.build_design(levels, ["current_month"], M.NUMERIC_CONTROLS, slope_by="dep_period")  # no indicators of its own
    rows = mf.select(d.packed().alias("p"), F.lit(0.0).alias("y"), *[e.alias(f"x{i}") for i, e in enumerate(d.exprs)]).toPandas()
    assert np.array_equal(d.matrix(np.vstack(rows.p)), by_rows(rows, d)[0])


def test_null_levels_are_the_base_and_null_numbers_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 2.0, 3.0), ("b", 4.0, 5.0), ("b", None, 1.0), ("a", 1.0, None)],
                               f"f string, {M.PREV} double, y double").withColumn("g", F.lit("all"))
    d = M.build_design({"f": ["a", "b"]}, ["f"], [])
    n, gram, moments, yy, sy = G.gram_sums(df, "g", d, "y")["all"]
    assert (n, sy, yy) == (3, 10.0, 38.0)
    assert gram.tolist() == [[3, 7, 1], [7, 21, 4], [1, 4, 1]] and moments.tolist() == [10, 28, 5]
    assert G.gram_sums(df.where("false"), "g", d, "y") == {}
