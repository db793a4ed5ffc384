"""Carry-over models: designs, fit results, and the tables built from them.

Design matrix: treatment-coded factors (first level is the base: alphabetical /
numeric order, except the declared order of ``dep_period`` and
``turnaround_bin``), numeric controls and an intercept.  Levels are found with
one small aggregation (bounded by the number of levels); dummies are plain
column expressions.  ``grouped`` does the fits.

Interaction models are treatment-coded (``prev``, level dummies, and ``prev:level``
for every level but the first).  A level's slope is the contrast ``prev +
prev:level``, with its standard error from the covariance of the two.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon import schema as S

NUMERIC_CONTROLS = ["scheduled_turnaround_minutes", "current_sched_dep_hour", "current_DISTANCE"]
CALENDAR_FACTORS = ["current_month", "current_day_of_week", "dep_period"]
DECLARED_ORDER = {"dep_period": S.DEP_PERIOD_LABELS, "turnaround_bin": S.TURNAROUND_LABELS}
PREV = "prev_ARR_DELAY"
Z975 = NormalDist().inv_cdf(0.975)


def t_quantile(p: float, df: float) -> float:
    """Student-t quantile by Cornish-Fisher expansion (accurate for df >= ~30)."""
    z = NormalDist().inv_cdf(p)
    if not df or df == math.inf:
        return z
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    return z + g1 / df + g2 / df ** 2 + g3 / df ** 3 + g4 / df ** 4


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by Wallace's normal transform (relative error below 1e-4 from df 50 on)."""
    z = (8 * df + 1) / (8 * df + 3) * math.sqrt(df * math.log1p(t * t / df))
    return math.erfc(z / math.sqrt(2))


def factor_levels(df: DataFrame, factors: list[str]) -> dict[str, list]:
    """Observed levels per factor in base-first order (one aggregation; O(levels))."""
    if not factors:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(f)).alias(f) for f in factors]).first()
    return levels_from_row(row, factors)


def levels_from_row(row, factors: list[str]) -> dict[str, list]:
    """Base-first level lists from a row of sorted level sets."""
    out = {}
    for f in factors:
        seen = list(row[f] or [])
        if f in DECLARED_ORDER:
            seen = [lv for lv in DECLARED_ORDER[f] if lv in set(seen)]
        out[f] = seen
    return out


@dataclass
class Design:
    """A design matrix: term names, column expressions, and what they are made of.

    Every column is a product of at most one numeric and at most one level
    indicator (``parts``), so a row is known by its numerics and one level code per
    factor (``packed``, ``matrix``), and sums of products by level are enough for
    normal equations (``grouped.cell_sums``).
    """
    numerics: list[str] = field(default_factory=list)
    coded: dict[str, list] = field(default_factory=dict)  # factor -> levels with a column
    names: list[str] = field(default_factory=list)
    exprs: list = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)  # (factor or None, level code, numeric or None)

    def add(self, name, expr, factor=None, code=0, numeric=None):
        self.names.append(name)
        self.exprs.append(expr.cast("double"))
        self.parts.append((factor, code, numeric))
        if numeric is not None and numeric not in self.numerics:
            self.numerics.append(numeric)

    def code(self, factor: str):
        """Number of the row's level among those with a column, from 1; else 0 (the base, null)."""
        levels = self.coded[factor]
        if not levels:
            return F.lit(0).cast("long")
        return F.coalesce(F.array_position(F.array(*map(F.lit, levels)), F.col(factor)), F.lit(0)).cast("long")

    def packed(self):
        """The row's numerics and level codes as one array."""
        return F.array(*[F.col(c).cast("double") for c in self.numerics],
                       *[self.code(f).cast("double") for f in self.coded]).cast("array<double>")

    def matrix(self, packed: np.ndarray) -> np.ndarray:
        """Intercept and design columns of packed rows."""
        numeric = {c: packed[:, i] for i, c in enumerate(self.numerics)}
        codes = {f: packed[:, len(self.numerics) + i] for i, f in enumerate(self.coded)}
        out = np.empty((len(packed), len(self.names) + 1), order="F")
        out[:, 0] = 1.0
        for at, (factor, code, name) in enumerate(self.parts, start=1):
            if factor is None:
                out[:, at] = numeric[name]
            else:
                np.equal(codes[factor], code, out=out[:, at])
                if name is not None:
                    out[:, at] *= numeric[name]
        return out


def _dummy(f, lv):
    return F.when(F.col(f) == F.lit(lv), 1.0).otherwise(0.0)


def build_design(levels: dict[str, list], factors: list[str], numerics: list[str],
                 slope_by: str | None = None, include_prev: bool = True) -> Design:
    """Treatment-coded design (no intercept column: the estimators add it).

    ``slope_by``: also one ``prev:level`` column per level of that factor but the first.
    """
    d = Design(coded={f: levels[f][1:] for f in [*factors, slope_by] if f is not None})
    if include_prev:
        d.add(PREV, F.col(PREV), numeric=PREV)
    for f in factors:
        for code, lv in enumerate(d.coded[f], start=1):
            d.add(f"C({f})[T.{lv}]", _dummy(f, lv), f, code)
    for c in numerics:
        d.add(c, F.col(c), numeric=c)
    if slope_by is not None:
        for code, lv in enumerate(d.coded[slope_by], start=1):
            d.add(slope_term(slope_by, lv), F.col(PREV) * _dummy(slope_by, lv), slope_by, code, PREV)
    return d


def slope_term(by: str, level) -> str:
    return f"{PREV}:C({by})[T.{level}]"


def model_factors(levels: dict[str, list], with_year: bool | None = None) -> list[str]:
    """Carrier + calendar factors; the year factor only when more than one year is present."""
    fs = ["OP_UNIQUE_CARRIER", *CALENDAR_FACTORS]
    if with_year is None:
        with_year = len(levels.get("current_year", [])) > 1
    if with_year:
        fs.append("current_year")
    # drop one-level factors (they add no column)
    return [f for f in fs if len(levels.get(f, [])) > 0]


@dataclass
class FitResult:
    model: str
    terms: list[str]
    estimates: list[float]
    std_errs: list[float]
    p_values: list[float]
    ci_mult: float
    metrics: dict
    cov: object = None  # covariance of the estimates


def _known(x) -> float | None:
    """A finite number, else null."""
    return float(x) if x is not None and math.isfinite(x) else None


def _exp(x: float) -> float:
    """exp that is infinite, not an error, beyond the range of doubles."""
    return math.exp(x) if x < 709.0 else math.inf


def coefficients(spark: SparkSession, fits: list[FitResult]) -> DataFrame:
    """Long coefficient table of all fitted models (t-based CIs for OLS, z for logit).

    Columns that a fit had to drop have null estimates.
    """
    rows = []
    for r in fits:
        logistic = r.model.startswith("logistic")
        for term, b, se, p in zip(r.terms, r.estimates, r.std_errs, r.p_values):
            rows.append((r.model, term, *map(_known, (
                b, se, b - r.ci_mult * se, b + r.ci_mult * se, p,
                _exp(b) if logistic else None, _exp(10.0 * b) if logistic else None))))
    return spark.createDataFrame(rows, "model string, term string, estimate double, std_err double, "
                                       "ci_lower double, ci_upper double, p_value double, "
                                       "odds_ratio double, odds_ratio_per_10 double")


def prev_term(r: FitResult) -> tuple[float, float, float]:
    i = r.terms.index(PREV)
    b, se = r.estimates[i], r.std_errs[i]
    return b, b - r.ci_mult * se, b + r.ci_mult * se


def slope_of(r: FitResult, by: str, level, base) -> tuple[float, float]:
    """Slope of one level and its standard error: ``prev`` plus the level's interaction."""
    i = r.terms.index(PREV)
    if level == base:
        return r.estimates[i], math.sqrt(r.cov[i, i])
    j = r.terms.index(slope_term(by, level))
    return r.estimates[i] + r.estimates[j], math.sqrt(r.cov[i, i] + r.cov[j, j] + 2 * r.cov[i, j])


def level_slopes(spark: SparkSession, r: FitResult, mf: DataFrame, by: str,
                 levels: list, key: str, present: list | None = None) -> DataFrame:
    """Per-level carry-over slope table (log-odds per minute, SE, 1.96-CI, OR10, n).

    ``present`` are the levels of the fit, base first; other levels get null slopes.
    """
    present = levels if present is None else present
    rows = []
    for lv in levels:
        b, se = slope_of(r, by, lv, present[0]) if lv in present else (math.nan, math.nan)
        lo, hi = b - 1.96 * se, b + 1.96 * se
        rows.append((str(lv), *map(_known, (b, se, lo, hi, _exp(10 * b), _exp(10 * lo), _exp(10 * hi)))))
    table = spark.createDataFrame(
        rows, f"{key} string, carryover_log_odds_per_1_min double, std_err double, "
              "ci_lower double, ci_upper double, odds_ratio_per_10_min double, "
              "or10_ci_lower double, or10_ci_upper double")
    counts = group_n_obs(mf, by, key)
    return table.join(counts, key, "left").withColumn(
        "n_obs", F.coalesce(F.col("n_obs"), F.lit(0).cast("long")))


def group_n_obs(mf: DataFrame, by: str, key: str | None = None) -> DataFrame:
    """Rows per level of a factor."""
    key = key or by
    return mf.groupBy(F.col(by).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("n_obs"))


def metrics_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """One row per model; a linear fit is solved directly and counts as converged."""
    cols = ["n_obs", "r_squared", "adj_r_squared", "aic", "bic", "deviance",
            "null_deviance", "roc_auc", "average_precision", "mean_target"]
    data = [(r["model"], *(_known(r.get(c)) for c in cols), r.get("converged", True)) for r in rows]
    return spark.createDataFrame(data, "model string, " + ", ".join(f"{c} double" for c in cols) + ", converged boolean")


def main_result(spark: SparkSession, n_obs: int, lin: FitResult, logit: FitResult):
    """The 12-column headline table and the 4-column linear table."""
    lb, llo, lhi = prev_term(lin)
    gb, glo, ghi = prev_term(logit)
    pooled = spark.createDataFrame([(
        int(n_obs), *map(_known, (gb, glo, ghi, _exp(gb), _exp(10 * gb), _exp(10 * glo),
                                  _exp(10 * ghi), lb, llo, lhi, 10 * lb)))],
        "n_modeling_pairs long, logistic_prev_arr_delay_coef double, logistic_ci_lower double, "
        "logistic_ci_upper double, logistic_odds_ratio_per_1_min double, "
        "logistic_odds_ratio_per_10_min double, logistic_or10_ci_lower double, "
        "logistic_or10_ci_upper double, linear_prev_arr_delay_coef double, linear_ci_lower double, "
        "linear_ci_upper double, minutes_carried_per_10_min_prev_delay double")
    secondary = pooled.select("linear_prev_arr_delay_coef", "linear_ci_lower", "linear_ci_upper",
                              "minutes_carried_per_10_min_prev_delay")
    return pooled, secondary
