"""Report tables: sampling, rankings, density grid, dataset totals, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.functions import scalar as X
from knockon.operators.quantiles import exact_quantiles
from knockon.session import materialize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sample_rows(df: DataFrame, keys, n: int = S.DEFAULT_SAMPLE_SIZE,
                seed: int = S.DEFAULT_SAMPLE_SEED) -> DataFrame:
    """Deterministic sample of up to n rows: the first n by md5(keys | seed).

    A bound on the hash, from the number of rows, leaves a few more than n rows
    before the sort, so the sort sees about n rows however large the input.
    """
    h = F.md5(F.concat_ws("|", *[_c(k).cast("string") for k in keys], F.lit(str(seed))))
    hashed = df.withColumn("_h", h)
    total = df.count()
    if total > 2 * n:
        share = (n + 10 * math.sqrt(n) + 100) / total
        near = hashed.where(F.col("_h") <= f"{int(min(share, 1.0) * (16 ** 8 - 1)):08x}" + "f" * 24)
        if near.count() >= n:
            hashed = near
    return hashed.orderBy("_h").limit(n).drop("_h")


def rank_by(df: DataFrame, col: str, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Sort descending by ``col``, ties by ``tie``; optional head (a top-k report)."""
    out = df.orderBy(F.col(col).desc_nulls_last(), *([tie] if tie else []))
    return out.limit(limit) if limit else out


def top_bottom(df: DataFrame, col: str, k: int = 6, tie: str | None = None) -> DataFrame:
    """k strongest and k weakest rows, ties by ``tie``; rows without a value are neither."""
    known, ties = df.where(F.col(col).isNotNull()), [tie] if tie else []
    top = known.orderBy(F.col(col).desc(), *ties).limit(k).withColumn("part", F.lit("top"))
    bottom = known.orderBy(F.col(col).asc(), *ties).limit(k).withColumn("part", F.lit("bottom"))
    return top.unionByName(bottom)


def density_grid(df: DataFrame, x: str, y: str, gridsize: int = S.HEX_GRID_SIZE) -> DataFrame:
    """Counts of (x, y) on a hexagonal grid (non-empty cells only).

    Hexagonal binning (Carr, Littlefield, Nicholson and Littlefield, 1987): cell
    centres are two rectangular lattices, the second shifted by half a cell both
    ways; a point belongs to the nearer of the nearest centre of each.  The
    points are written once; bounds and counts are an aggregation each.
    """
    points = materialize(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    edge = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if edge[0] is None:
        return points.sparkSession.createDataFrame(
            [], "lattice int, i int, j int, center_x double, center_y double, count long")
    across, up = gridsize, int(gridsize / math.sqrt(3))
    left, right = _widened(edge[0], edge[1])
    low, high = _widened(edge[2], edge[3])
    margin = 1e-9 * (right - left)
    left, right = left - margin, right + margin
    width, height = (right - left) / across, (high - low) / up
    u, v = (F.col("x") - left) / width, (F.col("y") - low) / height
    at = points.select(u.alias("u"), v.alias("v")).select(
        "u", "v", F.rint("u").cast("int").alias("i1"), F.rint("v").cast("int").alias("j1"),
        F.floor("u").cast("int").alias("i2"), F.floor("v").cast("int").alias("j2"))

    def distance(i, j, shift):  # rows are sqrt(3) apart in units of the column width
        return (F.col("u") - F.col(i) - shift) ** 2 + 3.0 * (F.col("v") - F.col(j) - shift) ** 2

    first = distance("i1", "j1", 0.0) < distance("i2", "j2", 0.5)
    inside = F.when(first, F.col("i1").between(0, across) & F.col("j1").between(0, up)).otherwise(
        F.col("i2").between(0, across - 1) & F.col("j2").between(0, up - 1))
    cells = at.where(inside).groupBy(
        F.when(first, 1).otherwise(2).alias("lattice"),
        F.when(first, F.col("i1")).otherwise(F.col("i2")).alias("i"),
        F.when(first, F.col("j1")).otherwise(F.col("j2")).alias("j")).agg(F.count(F.lit(1)).alias("count"))
    shift = F.when(F.col("lattice") == 2, 0.5).otherwise(0.0)
    return cells.select("lattice", "i", "j", (left + (F.col("i") + shift) * width).alias("center_x"),
                        (low + (F.col("j") + shift) * height).alias("center_y"), "count")


def _widened(low: float, high: float) -> tuple[float, float]:
    """Bounds of an axis; an axis of one value reaches a tenth of it (of 1, if it is 0) to either side."""
    reach = 0.0 if high > low else 0.1 * (abs(low) or 1.0)
    return low - reach, high + reach


def delay_rate_by_bin(frame: DataFrame) -> DataFrame:
    """Share of next departures over 15 minutes late by bin of the previous arrival delay (non-empty bins)."""
    binned = frame.select(X.prev_delay_bin("prev_ARR_DELAY").alias("prev_delay_bin"),
                          X.prev_delay_bin_index("prev_ARR_DELAY").alias("bin_order"), "current_dep_delayed_15")
    return (binned.where(F.col("prev_delay_bin").isNotNull()).groupBy("prev_delay_bin", "bin_order")
            .agg(F.avg("current_dep_delayed_15").alias("delay_rate"), F.count(F.lit(1)).alias("n_obs"))
            .orderBy("bin_order"))


def yearly_summary(periods: DataFrame) -> DataFrame:
    """The yearly fits in the columns of the year table."""
    return periods.select(
        F.col("start_year").alias("year"), "n_modeling_pairs",
        F.col("logistic_or_per_10_min").alias("logistic_or_per_10min"),
        F.col("logistic_or10_ci_lower"), F.col("logistic_or10_ci_upper"),
        F.col("minutes_carried_per_10_min").alias("minutes_carried_per_10min"))


def dataset_totals(clean: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cleaned rows, pair rows and months used - one aggregation over the union."""
    tagged = (clean.select(F.lit(1).alias("_c"), F.lit(0).alias("_p"),
                           F.date_format("FL_DATE", "yyyy-MM").alias("_m"))
              .unionByName(pairs.select(F.lit(0).alias("_c"), F.lit(1).alias("_p"),
                                        F.lit(None).cast("string").alias("_m"))))
    return tagged.agg(F.sum("_c").cast("long").alias("total_cleaned_flights"),
                      F.sum("_p").cast("long").alias("total_flight_pairs"),
                      F.count_distinct("_m").alias("total_months_used"))


def write_report(df: DataFrame, path: str) -> None:
    """Write a small report table (at most a few hundred rows) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def presentation_metrics(spark: SparkSession, main: DataFrame, metrics: DataFrame) -> DataFrame:
    """Six (metric, value) rows from the headline table and the model metrics."""
    m = main.select(
        F.col("n_modeling_pairs").cast("double").alias("n_modeling_pairs"),
        F.col("minutes_carried_per_10_min_prev_delay").alias("linear_minutes_carried_per_10_min_prev_delay"),
        F.col("logistic_odds_ratio_per_10_min").alias("logistic_odds_ratio_per_10_min_prev_delay"))
    lg = metrics.where("model = 'logistic'").select(
        F.col("roc_auc").alias("logistic_roc_auc"),
        F.col("average_precision").alias("logistic_average_precision"))
    ln = metrics.where("model = 'linear'").select(F.col("r_squared").alias("linear_r_squared"))
    wide = _one_row_join(m, lg, ln)
    names = ["n_modeling_pairs", "linear_minutes_carried_per_10_min_prev_delay",
             "logistic_odds_ratio_per_10_min_prev_delay", "logistic_roc_auc",
             "logistic_average_precision", "linear_r_squared"]
    return wide.unpivot([], names, "metric", "value")


def _one_row_join(*frames: DataFrame) -> DataFrame:
    """Combine one-row frames side by side without a join: stack them (missing columns
    null) and keep each column's single non-null value."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def final_summary(totals: DataFrame, coefficients: DataFrame, main: DataFrame,
                  decay_params: DataFrame | None, boot_ci: DataFrame | None) -> DataFrame:
    """One-row summary: counts, carry-over coefficients and CIs, odds ratios, decay rate,
    its bootstrap CI and half-life.  Missing inputs give nulls."""
    spark = totals.sparkSession

    def coef(model, field, alias):
        return (coefficients.where((F.col("model") == model) & (F.col("term") == "prev_ARR_DELAY"))
                .select(F.col(field).alias(alias)))

    parts = [
        totals.select(F.col("total_months_used").alias("total_raw_files_used"),
                      "total_cleaned_flights", "total_flight_pairs"),
        coef("linear", "estimate", "main_carryover_coefficient"),
        coef("logistic", "estimate", "logistic_prev_delay_coefficient"),
        coef("logistic", "odds_ratio", "logistic_prev_delay_odds_ratio"),
        main.select("logistic_odds_ratio_per_10_min", "logistic_or10_ci_lower", "logistic_or10_ci_upper"),
    ]
    if boot_ci is not None:
        parts.append(boot_ci.select(F.col("beta_prev_arr_delay_ci_lower").alias("bootstrap_ci_lower"),
                                    F.col("beta_prev_arr_delay_ci_upper").alias("bootstrap_ci_upper"),
                                    F.col("lambda_decay_ci_lower").alias("decay_lambda_ci_lower"),
                                    F.col("lambda_decay_ci_upper").alias("decay_lambda_ci_upper")))
    else:
        parts.append(spark.createDataFrame([(None, None, None, None)],
                                           "bootstrap_ci_lower double, bootstrap_ci_upper double, "
                                           "decay_lambda_ci_lower double, decay_lambda_ci_upper double"))
    if decay_params is not None:
        parts.append(decay_params.select(F.col("lambda").alias("decay_lambda"),
                                         F.col("half_life_legs").alias("decay_half_life_legs")))
    else:
        parts.append(spark.createDataFrame([(None, None)], "decay_lambda double, decay_half_life_legs double"))
    wide = _one_row_join(*parts)
    return wide.select(
        "total_raw_files_used", "total_cleaned_flights", "total_flight_pairs",
        "main_carryover_coefficient", "bootstrap_ci_lower", "bootstrap_ci_upper",
        "logistic_prev_delay_coefficient", "logistic_prev_delay_odds_ratio",
        "logistic_odds_ratio_per_10_min", "logistic_or10_ci_lower", "logistic_or10_ci_upper",
        "decay_lambda", "decay_lambda_ci_lower", "decay_lambda_ci_upper", "decay_half_life_legs")


def quantile_range(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99,
                   exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """The (lo, hi) quantiles of ``col`` (the plotting range of the previous delay).

    ``exact`` narrows the ranks down by counting (``quantiles``), so no task holds the
    distinct values; ``exact=False`` uses one mergeable sketch."""
    if exact:
        found = exact_quantiles(df, col, [lo, hi])
        return df.sparkSession.createDataFrame([tuple(found)], "q_lo double, q_hi double")
    q = F.percentile_approx(F.col(col), [lo, hi], accuracy)
    return df.agg(q.alias("q")).select(F.col("q")[0].cast("double").alias("q_lo"),
                                       F.col("q")[1].cast("double").alias("q_hi"))
