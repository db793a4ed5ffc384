"""NumPy parity for the distributed fits, ranking metrics, decay fit and bootstrap."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from knockon.operators import bootstrap as B
from knockon.operators import decay as D
from knockon.operators import grouped as G
from knockon.operators import metrics as ME
from knockon.operators import models as M
from knockon.plans import catalog as K
from knockon.plans.suite import fit_suite


@pytest.fixture(scope="module")
def mf(spark, sf_dir):
    return K.mf_of(spark, sf_dir, "lineitem").checkpoint(eager=True)


def _matrix(pdf, names):
    cols = [np.ones(len(pdf))]
    for n in names:
        if n.startswith("C("):
            f = n[2:n.index(")")]
            lv = n[n.index("[T.") + 3:-1]
            cols.append((pdf[f].astype(str) == lv).astype(float).to_numpy())
        else:
            cols.append(pdf[n].astype(float).to_numpy())
    return np.column_stack(cols)


def test_ols_logit_auc_ap_match_numpy(spark, mf):
    out = fit_suite(spark, mf, models=("linear", "logistic"))
    lin, logit = out["_fits"]["linear"], out["_fits"]["logistic"]
    pdf = mf.toPandas()
    X = _matrix(pdf, lin.terms[1:])
    y = pdf.current_DEP_DELAY.to_numpy(float)
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    r = y - X @ b
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (r @ r) / (len(y) - X.shape[1]))
    assert np.allclose(b, lin.estimates, atol=1e-8)
    assert np.allclose(se, lin.std_errs, atol=1e-8)
    n, k = len(y), X.shape[1]
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(r @ r / n) + 1)
    assert abs(lin.metrics["aic"] - (-2 * llf + 2 * k)) < 1e-6
    assert abs(lin.metrics["bic"] - (-2 * llf + k * math.log(n))) < 1e-6
    r2 = 1 - (r @ r) / ((y - y.mean()) ** 2).sum()
    assert abs(lin.metrics["r_squared"] - r2) < 1e-9
    assert abs(lin.metrics["adj_r_squared"] - (1 - (1 - r2) * (n - 1) / (n - k))) < 1e-9
    yb = pdf.current_dep_delayed_15.to_numpy(float)
    beta = np.zeros(k)
    for _ in range(100):
        mu = 1 / (1 + np.exp(-(X @ beta)))
        w = mu * (1 - mu)
        nb = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * (X @ beta) + yb - mu))
        done = np.max(np.abs(nb - beta)) < 1e-12
        beta = nb
        if done:
            break
    assert np.allclose(beta, logit.estimates, atol=1e-7)
    mu = 1 / (1 + np.exp(-(X @ beta)))
    errors = np.sqrt(np.diag(np.linalg.inv(X.T @ (X * (mu * (1 - mu))[:, None]))))
    assert np.allclose(errors, logit.std_errs, atol=1e-7)
    deviance = -2 * np.sum(yb * np.log(mu) + (1 - yb) * np.log(1 - mu))
    rate = yb.mean()
    null = -2 * n * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    assert abs(logit.metrics["deviance"] - deviance) < 1e-5 and abs(logit.metrics["null_deviance"] - null) < 1e-5
    assert abs(logit.metrics["aic"] - (deviance + 2 * k)) < 1e-5 and logit.metrics["converged"]
    main = out["main_result"].first()
    assert abs(main.logistic_odds_ratio_per_10_min - math.exp(10 * beta[1])) < 1e-5
    shown = dict(out_metrics(spark, out))
    assert abs(shown["linear_r_squared"] - r2) < 1e-9 and shown["n_modeling_pairs"] == n
    g = pd.DataFrame({"s": mu, "y": yb}).groupby("s").agg(tp=("y", "sum"), n=("y", "size")).sort_index(ascending=False)
    g["fp"] = g.n - g.tp
    ctp, cfp = g.tp.cumsum(), g.fp.cumsum()
    P_, N_ = yb.sum(), len(yb) - yb.sum()
    auc = float(np.sum(g.fp * (2 * ctp - g.tp) / 2) / (P_ * N_))
    ap = float(np.sum(g.tp / P_ * ctp / (ctp + cfp)))
    assert abs(auc - logit.metrics["roc_auc"]) < 1e-6
    assert abs(ap - logit.metrics["average_precision"]) < 1e-6


def out_metrics(spark, out):
    from knockon.operators import reports as R
    return [(r.metric, r.value) for r in R.presentation_metrics(spark, out["main_result"], out["metrics"]).collect()]


@pytest.mark.parametrize("name,by,key", [("airline", "OP_UNIQUE_CARRIER", "airline"),
                                         ("turnaround", "turnaround_bin", "turnaround_bin")])
def test_level_slopes_equal_numpy_contrasts(spark, mf, name, by, key):
    out = fit_suite(spark, mf, models=(name,))
    fit = out["_fits"][name]
    pdf = mf.toPandas()
    plain = [t for t in fit.terms[1:] if ":" not in t]
    cross = [t for t in fit.terms[1:] if ":" in t]
    X = _matrix(pdf, plain)
    levels = [t[t.index("[T.") + 3:-1] for t in cross]
    X = np.column_stack([X] + [pdf.prev_ARR_DELAY.astype(float) * (pdf[by].astype(str) == lv) for lv in levels])
    assert fit.terms[1:] == plain + cross
    y = pdf.current_dep_delayed_15.to_numpy(float)
    beta = np.zeros(X.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-(X @ beta)))
        w = mu * (1 - mu)
        beta = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * (X @ beta) + y - mu))
    cov = np.linalg.inv(X.T @ (X * w[:, None]))
    i = fit.terms.index("prev_ARR_DELAY")
    want = {}
    for j, lv in enumerate(levels):
        k = 1 + len(plain) + j
        want[lv] = beta[i] + beta[k], math.sqrt(cov[i, i] + cov[k, k] + 2 * cov[i, k])
    table = {r[key]: r for r in out[f"{name}_carryover"].collect()}
    base = (set(pdf[by].astype(str)) - set(levels)).pop()
    want[base] = beta[i], math.sqrt(cov[i, i])
    for lv, (slope, error) in want.items():
        assert abs(table[lv].carryover_log_odds_per_1_min - slope) < 1e-8
        assert abs(table[lv].std_err - error) < 1e-8
        assert abs(table[lv].odds_ratio_per_10_min - math.exp(10 * slope)) < 1e-6
    assert sum(r.n_obs for r in table.values()) == len(pdf)
    terms = {r.term: r.estimate for r in out["coefficients"].collect()}
    assert all(abs(terms[t] - beta[1 + len(plain) + j]) < 1e-8 for j, t in enumerate(cross))


def test_t_quantile():
    assert abs(M.t_quantile(0.975, 1e9) - 1.959963984540054) < 1e-8
    assert abs(M.t_quantile(0.975, 100) - 1.9839715184496334) < 1e-6


def test_t_tail():
    # table values: 5 % and 1 % two-sided points
    for df, five, one in ((60, 2.000298, 2.660283), (120, 1.979930, 2.617421), (1e7, 1.959964, 2.575829)):
        assert abs(M.t_tail(five, df) - 0.05) < 2e-5 and abs(M.t_tail(-one, df) - 0.01) < 2e-5


def test_decay_fit_brute_force():
    k = np.arange(1, 6, dtype=float)
    y = 60 * np.exp(-0.12 * k) + np.array([0.5, -0.3, 0.2, -0.1, 0.05])
    a, lam = D.fit_exponential(k, y)
    grid = np.linspace(0, 1, 200001)
    sse = [np.sum((y - (np.exp(-g * k) @ y / (np.exp(-g * k) @ np.exp(-g * k))) * np.exp(-g * k)) ** 2) for g in grid]
    assert abs(lam - grid[int(np.argmin(sse))]) < 1e-4
    assert math.isnan(D.fit_exponential(k, np.array([5.0, -1, -2, -3, -4]))[1])


def test_bootstrap_beta_matches_weighted_lstsq(spark, mf):
    w = B.cluster_weights(mf, 3, 7).checkpoint(eager=True)
    got = dict(B.bootstrap_beta(mf, w).select("replicate", "beta_prev_arr_delay").collect())
    d = B.bootstrap_design(mf)
    pdf = mf.select("TAIL_NUM", "current_DEP_DELAY", *[e.alias(f"x{i}") for i, e in enumerate(d.exprs)]).toPandas()
    X = np.column_stack([np.ones(len(pdf))] + [pdf[f"x{i}"].to_numpy() for i in range(len(d.exprs))])
    y = pdf.current_DEP_DELAY.to_numpy()
    wp = w.toPandas()
    for r in range(3):
        sub = wp[wp.replicate == r]
        ww = pdf.TAIL_NUM.map(dict(zip(sub.TAIL_NUM, sub.bootstrap_count))).fillna(0).to_numpy(float)
        bb = np.linalg.lstsq(X.T @ (X * ww[:, None]), X.T @ (ww * y), rcond=None)[0]
        assert abs(bb[1 + d.names.index("prev_ARR_DELAY")] - got[r]) < 1e-7


def test_all_ones_weights_reproduce_ols(spark, mf):
    tails = mf.select("TAIL_NUM").distinct()
    ones = tails.select(F.lit(0).alias("replicate"), "TAIL_NUM", F.lit(1).cast("long").alias("bootstrap_count"))
    beta = B.bootstrap_beta(mf, ones).collect()[0].beta_prev_arr_delay
    d = B.bootstrap_design(mf)
    lin = G.fit_ols(mf, d)
    assert abs(beta - lin.estimates[lin.terms.index("prev_ARR_DELAY")]) < 1e-8


def test_ranking_metrics_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    r = ME.ranking_metrics(df, "s", "y").collect()[0]
    assert r.roc_auc is None and r.average_precision is None


def test_too_few_rows_errors(spark, mf):
    with pytest.raises(ValueError):
        fit_suite(spark, mf.limit(50))


def test_period_fits_equal_separate_fits(spark, mf):
    from knockon.plans import suite as SU
    years = SU.years_of(mf)
    periods = SU.window_periods(years, 3)
    table = {r.period: r for r in SU.fit_periods(spark, mf, periods).collect()}
    assert len(table) == len(periods) and {r.status for r in table.values()} == {"ok"}
    for name, first, last in periods:
        part = mf.where(F.col("current_year").between(first, last))
        fits = fit_suite(spark, part, models=("linear", "logistic"))["_fits"]
        lin, logit, row = fits["linear"], fits["logistic"], table[name]
        assert row.n_modeling_pairs == part.count()
        assert np.allclose([row.linear_coef, row.linear_ci_lower, row.linear_ci_upper], M.prev_term(lin), atol=1e-8)
        assert abs(row.linear_r_squared - lin.metrics["r_squared"]) < 1e-9
        assert np.allclose(np.log([row.logistic_or_per_10_min, row.logistic_or10_ci_lower, row.logistic_or10_ci_upper]),
                           10 * np.array(M.prev_term(logit)), atol=1e-6)
        assert abs(row.logistic_auc - logit.metrics["roc_auc"]) < 1e-6
        assert abs(row.logistic_average_precision - logit.metrics["average_precision"]) < 1e-6


def test_small_and_degenerate_periods_do_not_stop_the_others(spark, mf):
    from knockon.plans import suite as SU
    years = SU.years_of(mf)[:5]
    small, flat, still, whole, split = years
    plain = SU.fit_periods(spark, mf, [("whole", whole, whole)]).first()

    def year(y):
        return mf.where(F.col("current_year") == y)

    table = (year(small).limit(5).unionByName(year(flat).withColumn("current_DISTANCE", F.lit(300.0)))
             .unionByName(year(still).withColumn("prev_ARR_DELAY", F.lit(7.0))).unionByName(year(whole))
             .unionByName(year(split).withColumn("current_dep_delayed_15", (F.col("prev_ARR_DELAY") > 0).cast("int"))))
    got = {r.start_year: r for r in SU.fit_periods(spark, table, SU.yearly_periods(years)).collect()}
    assert got[small].status == "too few rows" and got[small].linear_coef is None and got[small].n_modeling_pairs == 5
    assert got[flat].status == "ok" and got[flat].logistic_coef is not None
    assert got[still].status == "no previous delay" and got[still].linear_coef is None
    assert got[split].status == "not converged" and got[split].logistic_coef is None
    assert abs(got[whole].linear_coef - plain.linear_coef) < 1e-9
    assert abs(got[whole].logistic_coef - plain.logistic_coef) < 1e-9


def test_decay_fit_has_no_ceiling():
    k = np.arange(1, 4, dtype=float)
    a, lam = D.fit_exponential(k, 1e40 * np.exp(-80.0 * k))
    assert abs(lam - 80.0) < 1e-6
    a, lam = D.fit_exponential(k, np.array([1.0, 2.0, 3.0]))
    assert lam == 0.0 and abs(a - 2.0) < 1e-12


def test_ranking_metrics_of_large_counts_and_empty_input(spark):
    empty = spark.createDataFrame([], "s double, y int")
    r = ME.ranking_metrics(empty, "s", "y").first()
    assert r.roc_auc is None and r.average_precision is None
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 0)], "s double, y int")
    for ranges in (1, 2, 50):
        r = ME.ranking_metrics(df, "s", "y", n_ranges=ranges).first()
        assert abs(r.roc_auc - 5 / 6) < 1e-12 and abs(r.average_precision - (1 + 2 / 3) / 2) < 1e-12
    from unittest import mock
    big = spark.createDataFrame([(0.9, 4_000_000_000, 1_000_000_000, 4_000_000_000, 1_000_000_000),
                                 (0.1, 1_000_000_000, 4_000_000_000, 5_000_000_000, 5_000_000_000)],
                                "score double, tp long, fp long, cum_tp long, cum_fp long")
    with mock.patch.object(ME, "score_curve", lambda *a, **k: big):
        assert abs(ME.ranking_metrics(big, "score", "tp").first().roc_auc - 0.8) < 1e-12


def test_large_tails_are_gathered_in_parts(spark, mf):
    hot = mf.withColumn("TAIL_NUM", F.when(F.rand(1) < 0.4, "HOT").otherwise(F.col("TAIL_NUM")))
    hot = hot.checkpoint(eager=True)
    d = B.bootstrap_design(hot)
    rows = hot.select(F.col("TAIL_NUM").alias("k"), F.col("prev_ARR_DELAY").alias("y"), F.array("current_DISTANCE").alias("x"))
    parts = B.gathered_by_tail(rows).groupBy("k").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n"))
    assert max(r.n / r.parts for r in parts.collect()) < 0.01 * hot.count()
    grams = B.tail_grams(hot, d).groupBy("TAIL_NUM").agg(F.sum(F.col("s")[0]).alias("n"))
    assert {r.TAIL_NUM: r.n for r in grams.collect()} == {r.TAIL_NUM: r["count"] for r in hot.groupBy("TAIL_NUM").count().collect()}
    w = B.cluster_weights(hot, 2, 5).checkpoint(eager=True)
    got = dict(B.bootstrap_beta(hot, w).collect())
    pdf = hot.join(w.where("replicate = 1"), "TAIL_NUM").select("bootstrap_count", "current_DEP_DELAY", *[
        e.alias(f"x{i}") for i, e in enumerate(d.exprs)]).toPandas()
    X = np.column_stack([np.ones(len(pdf))] + [pdf[f"x{i}"] for i in range(len(d.exprs))])
    ww = pdf.bootstrap_count.to_numpy(float)
    b = np.linalg.lstsq(X.T @ (X * ww[:, None]), X.T @ (ww * pdf.current_DEP_DELAY), rcond=None)[0]
    assert abs(b[1 + d.names.index("prev_ARR_DELAY")] - got[1]) < 1e-7


def test_poisson_weights_have_unit_mean(spark, mf):
    w = B.poisson_weights(mf, 40, 11)
    tails = mf.select("TAIL_NUM").distinct().count()
    total = w.agg(F.sum("bootstrap_count")).first()[0]
    assert abs(total / (40 * tails) - 1.0) < 0.1
    t = B.run_bootstrap(spark, mf, None, 3, 5, scheme="poisson").collect()
    assert len(t) == 3 and all(r.beta_prev_arr_delay is not None for r in t)
