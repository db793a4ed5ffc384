"""Model suite: the pooled linear + logistic fits, metrics, headline tables and
the per-carrier / per-turnaround slope models over one model frame.

The model frame is one Parquet stage with the columns that the fits read.  Only
the models asked for are fitted; every fit is distributed, and only p x p
matrices and small result tables reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.functions import scalar as X
from knockon.operators import features as FE
from knockon.operators import grouped as G
from knockon.operators import metrics as ME
from knockon.operators import models as M
from knockon.session import materialize

MODELS = ("linear", "logistic", "airline", "turnaround")
LEVEL_COLUMNS = ["OP_UNIQUE_CARRIER", *M.CALENDAR_FACTORS, "current_year", "turnaround_bin"]


@dataclass
class Frame:
    """A written model frame with its row count, target means and factor levels."""
    rows: DataFrame
    n: int
    mean_dep: float
    mean_flag: float
    levels: dict


def frame_of(mf: DataFrame) -> Frame:
    """Write the model columns once and look at them in one pass."""
    rows = materialize(mf.select(*FE.MODEL_COLUMNS), "model-frame")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("current_DEP_DELAY").alias("mean_dep"),
                     F.avg("current_dep_delayed_15").alias("mean_flag"),
                     *[F.sort_array(F.collect_set(f)).alias(f) for f in LEVEL_COLUMNS]).first()
    n = FE.enough_rows(int(stats["n"]))
    return Frame(rows, n, stats["mean_dep"], stats["mean_flag"], M.levels_from_row(stats, LEVEL_COLUMNS))


def fit_suite(spark: SparkSession, mf: DataFrame, models=MODELS, with_year: bool | None = None,
              factors: list[str] | None = None, numerics: list[str] | None = None) -> dict:
    """The models asked for and their tables.

    ``factors`` and ``numerics`` replace the standard controls (empty lists give
    the models of the previous delay alone).  Keys: ``coefficients``,
    ``metrics``; ``main_result`` and ``secondary_result`` with both pooled
    models; ``predict_scores`` with the logistic one; ``airline_carryover`` and
    ``turnaround_carryover`` with theirs.  A level whose rows all have the same
    outcome is in ``separated``; its rows stay out of the logit fits, and its
    carry-over row has null slopes.  A logit without a maximum has null estimates
    and ``converged`` false; the other models are not touched.
    """
    frame = frame_of(mf)
    levels, rows = frame.levels, frame.rows
    factors = M.model_factors(levels, with_year) if factors is None else factors
    numerics = M.NUMERIC_CONTROLS if numerics is None else numerics
    pooled = M.build_design(levels, factors, numerics)
    out, fits, metrics = {}, {}, []
    logits = [name for name in models if name != "linear"]
    by_level = [f for f in dict.fromkeys([*factors, "OP_UNIQUE_CARRIER" if "airline" in models else None,
                                          "turnaround_bin" if "turnaround" in models else None]) if f]
    separated = G.separated_levels(rows, by_level) if logits else []
    known = {f: [lv for lv in of if not any((f, str(lv)) == s[:2] for s in separated)] for f, of in levels.items()}
    mixed = materialize(G.without_levels(rows, separated), "logit-frame") if separated else rows
    out["separated"] = spark.createDataFrame(separated, "factor string, level string, n_obs long, outcome int")
    pooled_logit = M.build_design(known, factors, numerics) if separated else pooled
    if "linear" in models:
        fits["linear"] = lin = G.fit_ols(rows, pooled, model="linear")
        lin.metrics["mean_target"] = frame.mean_dep
        metrics.append(lin.metrics)
    if "logistic" in models:
        fits["logistic"] = logit = G.fit_logit(mixed, pooled_logit, model="logistic")
        metrics.append(logit.metrics)
        if logit.metrics["converged"]:
            scored = G.predict(mixed, pooled_logit, logit)
            rank = ME.ranking_metrics(scored, "prediction", "label").first()
            logit.metrics |= {"roc_auc": rank["roc_auc"], "average_precision": rank["average_precision"],
                              "mean_target": logit.metrics["mean_target"] if separated else frame.mean_flag}
            out["predict_scores"] = scored
    if "linear" in fits and "logistic" in fits:
        out["main_result"], out["secondary_result"] = M.main_result(spark, frame.n, fits["linear"], fits["logistic"])
    for name, by, key, shown in (("airline", "OP_UNIQUE_CARRIER", "airline", levels["OP_UNIQUE_CARRIER"]),
                                 ("turnaround", "turnaround_bin", "turnaround_bin", S.TURNAROUND_LABELS)):
        if name in models:
            design = M.build_design(known, [by, *[f for f in factors if f != by]], numerics, slope_by=by)
            fits[name] = G.fit_logit(mixed, design, model=f"logistic_{name}_interaction")
            table = M.level_slopes(spark, fits[name], rows, by, shown, key, present=known[by])
            out[f"{name}_carryover"] = table.orderBy(
                X.turnaround_bin_rank(key) if name == "turnaround" else F.col("odds_ratio_per_10_min").desc_nulls_last(),
                key)
    out["coefficients"] = M.coefficients(spark, list(fits.values()))
    out["metrics"] = M.metrics_frame(spark, metrics) if metrics else None
    out["_fits"] = fits
    return out


def years_of(mf: DataFrame) -> list[int]:
    """Distinct years of the model frame (one small aggregation)."""
    return sorted(r[0] for r in mf.select("current_year").distinct().collect())


def yearly_periods(years: list[int]) -> list[tuple[str, int, int]]:
    return [(str(y), y, y) for y in years]


def window_periods(years: list[int], width: int = 3) -> list[tuple[str, int, int]]:
    """Consecutive windows of ``width`` years (the last may be shorter)."""
    out = []
    for i in range(0, len(years), width):
        chunk = years[i:i + width]
        out.append((f"{chunk[0]}-{chunk[-1]}" if len(chunk) > 1 else str(chunk[0]),
                    chunk[0], chunk[-1]))
    return out


def fit_periods(spark: SparkSession, mf: DataFrame, periods: list[tuple[str, int, int]],
                factors: list[str] | None = None, numerics: list[str] | None = None) -> DataFrame:
    """The pooled models of every period (name, first year, last year), one row each.

    All periods are solved together (grouped normal equations, grouped IRLS), so
    the passes over the rows do not grow with their number.  Periods must not
    overlap.  A period that cannot be fitted keeps its row, with a status.
    """
    label = F.lit(None).cast("string")
    for name, lo, hi in periods:
        label = F.when(F.col("current_year").between(lo, hi), F.lit(name)).otherwise(label)
    framed = materialize(mf.select(*FE.MODEL_COLUMNS, label.alias("_period")).where(F.col("_period").isNotNull()),
                         "period-frame")
    levels = M.factor_levels(framed, ["OP_UNIQUE_CARRIER", *M.CALENDAR_FACTORS, "current_year"])
    if factors is None:
        factors = M.model_factors(levels, with_year=len(levels["current_year"]) > 1)
    design = M.build_design(levels, factors, M.NUMERIC_CONTROLS if numerics is None else numerics)
    table = G.period_table(spark, framed, design, "_period")
    bounds = spark.createDataFrame(periods, "period string, start_year int, end_year int")
    return table.join(bounds, "period").select(
        "period", "start_year", "end_year", *[c for c in table.columns if c != "period"])
