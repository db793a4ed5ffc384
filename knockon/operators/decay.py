"""Delay decay over later legs of the same tail.

later legs (lead 1..K over the tail chain) -> shock rows -> per (tail, k)
count / mean / exact median -> per k pooled mean and weighted median of tail
medians -> exponential fit A*exp(-lambda*k) per group (applyInPandas; a group
holds at most K points).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.operators.chain import chain_links
from knockon.operators.pairs import chain_order


def later_legs(clean: DataFrame, max_leg: int = S.MAX_LEG, tiebreak=(), split="auto") -> DataFrame:
    """Each flight with ``next_dep_delay_k`` = DEP_DELAY k flights later (same tail, no
    airport or turnaround condition; crosses days)."""
    linked = chain_links(clean, "TAIL_NUM", chain_order(tiebreak), lead_col="DEP_DELAY",
                         max_lead=max_leg, split=split)
    for k in range(1, max_leg + 1):
        linked = linked.withColumnRenamed(f"_next_{k}", f"next_dep_delay_{k}")
    return linked.drop("_prev")


def shock_rows(legs: DataFrame, threshold: float = S.SHOCK_THRESHOLD) -> DataFrame:
    """Flights whose arrival delay exceeds the threshold (applied after the lead window)."""
    return legs.where(F.col("ARR_DELAY") > F.lit(threshold))


def tail_leg_summary(clean: DataFrame, max_leg: int = S.MAX_LEG,
                     threshold: float = S.SHOCK_THRESHOLD, tiebreak=(), split="auto") -> DataFrame:
    """Per (tail, k): n_obs, mean and exact median of the departure delay k legs after a shock.

    ``median`` is Spark's exact percentile, whose buffer is a value->count map merged
    map-side, so a hot tail costs distinct delay values, not rows.
    """
    return tail_leg_summary_of_legs(later_legs(clean, max_leg, tiebreak, split), max_leg, threshold)


def tail_leg_summary_of_legs(legs: DataFrame, max_leg: int = S.MAX_LEG,
                             threshold: float = S.SHOCK_THRESHOLD,
                             arr_col: str = "ARR_DELAY") -> DataFrame:
    """Tail-leg summary from rows that already carry ``next_dep_delay_1..k``
    (e.g. pair candidates built with ``max_lead``, whose arrival delay is
    ``current_ARR_DELAY``)."""
    shocks = legs.where(F.col(arr_col) > F.lit(threshold))
    long = shocks.select("TAIL_NUM", F.explode(F.array(*[
        F.struct(F.lit(k).alias("leg_index"), F.col(f"next_dep_delay_{k}").alias("v"))
        for k in range(1, max_leg + 1)])).alias("x")).select("TAIL_NUM", "x.leg_index", "x.v")
    return (long.where(F.col("v").isNotNull())
            .groupBy("TAIL_NUM", "leg_index")
            .agg(F.count(F.lit(1)).alias("n_obs"),
                 F.avg("v").alias("mean_remaining_delay"),
                 F.median("v").alias("median_remaining_delay")))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str,
                    out: str = "weighted_median") -> DataFrame:
    """Lower weighted median per group: the smallest value whose cumulative weight
    (values ascending) reaches half the group's total weight.

    Weights are first summed per distinct (group, value), so the ordered running sum
    runs over distinct values only.
    """
    hist = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*by)
    return (hist.withColumn("_cum", F.sum("_w").over(w))
            .withColumn("_tot", F.sum("_w").over(tot))
            .where(F.col("_cum") >= F.col("_tot") * 0.5)
            .groupBy(*by).agg(F.min(value).alias(out)))


def decay_by_leg(tail_summary: DataFrame) -> DataFrame:
    """Per leg k: total n, n-weighted mean of tail means (the pooled mean) and the
    weighted median of tail medians."""
    pooled = (tail_summary.groupBy("leg_index")
              .agg(F.sum("n_obs").alias("n_obs"),
                   (F.sum(F.col("n_obs") * F.col("mean_remaining_delay")) / F.sum("n_obs"))
                   .alias("mean_remaining_delay")))
    med = weighted_median(tail_summary, ["leg_index"], "median_remaining_delay", "n_obs",
                          out="median_remaining_delay")
    return pooled.join(med, "leg_index").orderBy("leg_index")


# ----------------------------------------------------------------------------- fit
def fit_exponential(k: np.ndarray, y: np.ndarray, lam0: float = S.DECAY_LAMBDA_START):
    """Least squares of y ~ A*exp(-lambda*k) with A, lambda >= 0 on points with y > 0.

    A is closed-form given lambda, so the fit is a one-dimensional search: a log
    grid that grows until the error rises at its end, then bisection of its slope.  The
    error can only keep falling while exp(-lambda) is above the precision of
    doubles, which ends the growth.  Fewer than 2 points -> NaN.
    """
    mask = np.isfinite(y) & (y > 0)
    k, y = np.asarray(k, float)[mask], np.asarray(y, float)[mask]
    if len(k) < 2:
        return math.nan, math.nan
    first = k.min()
    after = k - first  # powers relative to the first leg do not underflow

    def level(lam):
        e = np.exp(-lam * after)
        return max(float(e @ y) / float(e @ e), 0.0), e

    def sse(lam):
        a, e = level(lam)
        return float(((y - a * e) ** 2).sum())

    top = 8.0 * max(lam0, 0.25)
    while True:
        grid = np.concatenate([[0.0], np.geomspace(1e-6, top, 600)])
        vals = np.array([sse(g) for g in grid])
        i = int(np.argmin(vals))
        if i < len(grid) - 1 or top * max(first, 1.0) > 600.0:
            break
        top *= 2.0
    low, high = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]

    def falling(lam):
        """The error still falls beyond lam (sign of the score)."""
        e = np.exp(-lam * after)
        return float(y @ e) * float(after @ (e * e)) > float(e @ e) * float(after @ (y * e))

    lam = float(grid[i])
    if (i > 0 or falling(0.0)) and not falling(high):
        for _ in range(200):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (middle, high) if falling(middle) else (low, middle)
        lam = float((low + high) / 2)
    return level(lam)[0] * math.exp(lam * first), lam


FIT_SCHEMA = "amplitude_A double, lambda double"


def fit_groups(decay_table: DataFrame, by: list[str], k: str = "leg_index",
               y: str = "mean_remaining_delay") -> DataFrame:
    """Grouped exponential fit (one group = one curve of at most K points)."""
    out_schema = ", ".join([f"{f.name} {f.dataType.simpleString()}"
                            for f in decay_table.schema.fields if f.name in by]
                           + [FIT_SCHEMA])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, lam = fit_exponential(pdf[k].to_numpy(float), pdf[y].to_numpy(float))
        row = {c: pdf[c].iloc[0] for c in by}
        row.update({"amplitude_A": a, "lambda": lam})
        return pd.DataFrame([row])

    if not by:
        return decay_table.groupBy(F.lit(0).alias("_all")).applyInPandas(fit, schema=FIT_SCHEMA)
    return decay_table.groupBy(*by).applyInPandas(fit, schema=out_schema)


def nan_to_null(c: str):
    return F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)


def decay_parameters(decay_table: DataFrame, threshold: float = S.SHOCK_THRESHOLD,
                     max_leg: int = S.MAX_LEG) -> DataFrame:
    """One row: amplitude, lambda, half-life (null unless lambda > 0), settings; no legs is an error."""
    if decay_table.isEmpty():
        raise ValueError(f"no later leg follows a delay over {threshold:g} minutes")
    fit = fit_groups(decay_table, [])
    return fit.select(
        nan_to_null("amplitude_A"), nan_to_null("lambda"),
        F.when(F.col("lambda") > 0, F.lit(math.log(2.0)) / F.col("lambda")).alias("half_life_legs"),
        F.lit(float(threshold)).alias("shock_threshold"),
        F.lit(int(max_leg)).alias("max_leg"),
        F.lit("future_departure_delay").alias("delay_measure"))


def decay_table(decay_by_leg_df: DataFrame, by: list[str] | None = None, k: str = "leg_index",
                y: str = "mean_remaining_delay") -> DataFrame:
    """decay_by_leg plus the fitted curve value (null when no fit), per group ``by``.

    One grouped pass: each curve (at most K rows) is fitted and returned with its
    fitted values, so no join back to the parameters is needed."""
    by = list(by or [])
    fields = [f for f in decay_by_leg_df.schema.fields]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields]
                       + ["fitted_decay_value double"])
    names = [f.name for f in fields]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, lam = fit_exponential(pdf[k].to_numpy(float), pdf[y].to_numpy(float))
        out = pdf[names].copy()
        out["fitted_decay_value"] = (a * np.exp(-lam * pdf[k].to_numpy(float))
                                     if math.isfinite(lam) else np.nan)
        return out

    grouped = decay_by_leg_df.groupBy(*by) if by else decay_by_leg_df.groupBy(F.lit(0).alias("_all"))
    res = grouped.applyInPandas(fit, schema=schema)
    return res.withColumn("fitted_decay_value", nan_to_null("fitted_decay_value")).orderBy(*by, k)


def decay_by_leg_by(clean: DataFrame, by: list[str], max_leg: int = S.MAX_LEG,
                    threshold: float = S.SHOCK_THRESHOLD, tiebreak=(), split="auto") -> DataFrame:
    """Pooled mean remaining delay per (group, k), e.g. per carrier of the shock flight."""
    shocks = shock_rows(later_legs(clean, max_leg, tiebreak, split), threshold)
    long = shocks.select(*by, F.explode(F.array(*[
        F.struct(F.lit(k).alias("leg_index"), F.col(f"next_dep_delay_{k}").alias("v"))
        for k in range(1, max_leg + 1)])).alias("x")).select(*by, "x.leg_index", "x.v")
    return (long.where(F.col("v").isNotNull()).groupBy(*by, "leg_index")
            .agg(F.count(F.lit(1)).alias("n_obs"), F.avg("v").alias("mean_remaining_delay")))
