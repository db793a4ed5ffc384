"""Grouped (per-period) OLS and logistic fits: all groups at once.

Refitting the pooled models per year or per window of years is a loop of fits
in the reference (one job per year).  Here every group is solved together.  OLS
takes one aggregation without Python: rows fold into contingency cells (equal
levels), and sums of products by pairs of levels make up each group's Gram
matrix.  The logit takes one pass per IRLS step (the current coefficients of
every group travel in the task closure: groups x p numbers) over the rows, which are
packed into blocks once (``row_blocks``): one vector per group and partition, added up cell by cell with partial aggregation.  The driver
solves one p x p system per group; its state is O(groups * p^2).

Each group keeps the column space a separate fit on that group would have:
columns that are all zero, constant or otherwise dependent in the group are
dropped, and when a factor's base level is absent from the group its first
present level becomes the base.  A group that cannot be fitted gets null
coefficients and says why in its status; it never stops the others.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon import schema as S
from knockon.operators import metrics as ME
from knockon.operators import models as M
from knockon.session import materialize


#: Halvings of one step before a fit is given up.
MOST_HALVINGS = 30
#: Bytes of a block of packed rows.  Readers hold many blocks at once: Parquet's up to 4,096 (or a row group's), Arrow's
#: up to 10,000 or 64 MB.
BLOCK_BYTES = 2048
#: Bytes of a row group of blocks, and rows that a step makes a matrix of at a time.
ROW_GROUP, STEP_ROWS = 16 << 20, 4096


def separated_levels(df: DataFrame, factors: list[str], label: str = "current_dep_delayed_15") -> list[tuple]:
    """(factor, level, rows, outcome) of the levels whose rows all have the same outcome.

    Such a level has no finite logit coefficient and tells nothing about the
    others.  Leaving its rows out may leave another level with one outcome, so the
    count (one aggregation over all factors) is repeated until none is left.
    """
    found: list[tuple] = []
    while factors:
        rest = without_levels(df, found)
        pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
        sums = (rest.select(F.explode(pairs).alias("at"), F.col(label).cast("double").alias("y"))
                .groupBy("at.factor", "at.level").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"),
                                                      F.max("y").alias("high")))
        new = [(r.factor, r.level, int(r.n), int(r.low)) for r in sums.where("low = high").orderBy("factor", "level").collect()]
        new = [x for x in new if x[1] is not None]
        if not new:
            break
        found += new
    return found


def without_levels(df: DataFrame, separated: list[tuple]) -> DataFrame:
    """Rows that have none of the levels."""
    for factor in sorted({f for f, *_ in separated}):
        gone = [level for f, level, *_ in separated if f == factor and level is not None]
        df = df.where(~F.coalesce(F.col(factor).cast("string").isin(gone), F.lit(False)))
    return df


def _factor_columns(design: M.Design) -> dict[str, list[int]]:
    """Design column indices (1-based: 0 is the intercept) per factor."""
    out: dict[str, list[int]] = {}
    for i, n in enumerate(design.names, start=1):
        if n.startswith("C(") and "[T." in n:
            out.setdefault(n[2:n.index(")")], []).append(i)
    return out


def _keep_columns(xtx: np.ndarray, n: float, factors: dict[str, list[int]]) -> np.ndarray:
    diag = np.diag(xtx)
    keep = diag > 0
    keep[0] = True
    for cols in factors.values():
        present = [c for c in cols if diag[c] > 0]
        if present and sum(diag[c] for c in present) >= n:   # base level absent in this group
            keep[present[0]] = False
    return independent_columns(xtx, keep)


def independent_columns(gram: np.ndarray, keep: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """``keep`` without the columns that the kept columns before them already span.

    Eliminates the kept columns one by one; what is left of a column's own
    square is its part outside the span.
    """
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    left = gram / np.outer(scale, scale)
    kept = np.zeros(len(keep), bool)
    for j in np.flatnonzero(keep):
        if left[j, j] <= tolerance:
            continue
        kept[j] = True
        left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return kept


def solve_kept(gram: np.ndarray, moments: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and the diagonal of the inverse, over the kept columns of a scaled system."""
    scale = np.sqrt(np.diag(gram)[keep])
    inverse = np.linalg.inv(gram[np.ix_(keep, keep)] / np.outer(scale, scale))
    return inverse @ (moments[keep] / scale) / scale, np.diag(inverse) / scale ** 2


def design_batches(rows: DataFrame, design: M.Design, run, schema: str) -> DataFrame:
    """``run(state, groups, X, y)`` per Arrow batch and, with None, once at the end of a partition.

    Rows bring their numerics and one level code per factor (``Design.packed``), one
    flat Arrow buffer a batch; the indicator columns are set in the task, so what
    crosses to Python does not grow with the levels.  ``run`` returns a RecordBatch or None.
    """
    shape = M.Design(numerics=design.numerics, coded=design.coded, names=design.names, parts=design.parts)
    width = len(design.numerics) + len(design.coded)

    def part(batches):
        state: dict = {}
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                out = run(state, batch.column(0), shape.matrix(flat), batch.column(1).to_numpy(zero_copy_only=False))
                if out is not None:
                    yield out
        out = run(state, None, None, None)
        if out is not None:
            yield out
    return rows.mapInArrow(part, schema)


def _rows(df: DataFrame, group: str, design: M.Design, label: str) -> DataFrame:
    return df.select(F.col(group).cast("string").alias("g"), F.col(label).cast("double").alias("y"),
                     design.packed().alias("x"))


def by_group(groups: pa.Array):
    """(group, row numbers) of a batch."""
    coded = groups.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(coded.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == i)


def cell_sums(df: DataFrame, group: str, design: M.Design, label: str) -> DataFrame:
    """Sums of products by group and by the levels of no, one or two factors (null: over all levels).

    ``m<i>_<j>`` is the sum of value i times value j, where the values are 1, the
    numerics and the label.  Rows first fold into cells of equal levels, before the
    shuffle, so what is shuffled is bounded by the levels; grouping sets then add up the cells.
    Rows with a null numeric or label are left out.
    """
    factors = [f"f{i}" for i in range(len(design.coded))]
    numbers = [*design.numerics, label]
    rows = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in numbers))).select(
        F.col(group).cast("string").alias("g"), *[design.code(f).alias(n) for f, n in zip(design.coded, factors)],
        *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers, start=1)])
    size = len(numbers) + 1
    value = [F.lit(1.0), *[F.col(f"v{i}") for i in range(1, size)]]
    names = [f"m{i}_{j}" for i in range(size) for j in range(i, size)]
    cells = rows.groupBy("g", *factors).agg(
        *[F.sum(value[i] * value[j] if i else value[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)])
    sets = [["g", *chosen] for k in range(3) for chosen in itertools.combinations(factors, k)]
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], F.col("g"), *map(F.col, factors)).agg(
        *[F.sum(n).alias(n) for n in names])


def gram_sums(df: DataFrame, group: str, design: M.Design, label: str) -> dict:
    """Per group: n, X'X, X'y, y'y, sum y, put together from ``cell_sums`` without a matrix of rows.

    An entry of X'X is the sum of a product of two numerics over the rows that have both columns' levels.
    """
    size = len(design.numerics) + 2
    slot = {None: 0, **{c: i for i, c in enumerate(design.numerics, start=1)}}
    at: dict[str, dict] = {}
    for r in cell_sums(df, group, design, label).collect():  # groups x pairs of levels
        levels = frozenset((f, r[f"f{i}"]) for i, f in enumerate(design.coded) if r[f"f{i}"] is not None)
        sums = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                sums[i, j] = sums[j, i] = r[f"m{i}_{j}"]
        at.setdefault(r["g"], {})[levels] = sums
    none = np.zeros((size, size))
    columns = [(frozenset(), 0), *[(frozenset() if f is None else frozenset([(f, code)]), slot[c])
                                   for f, code, c in design.parts]]
    out = {}
    for g, cells in at.items():
        gram = np.zeros((len(columns), len(columns)))
        for i, (mine, u) in enumerate(columns):
            for j, (other, v) in enumerate(columns[:i + 1]):
                gram[i, j] = gram[j, i] = cells.get(mine | other, none)[u, v]  # two levels of one factor: no rows
        moments = np.array([cells.get(levels, none)[u, -1] for levels, u in columns])
        whole = cells[frozenset()]
        out[g] = (whole[0, 0], gram, moments, whole[-1, -1], whole[0, -1])
    return out


def _block_rows(width: int) -> int:
    """Rows of a block: label and ``width`` numbers each."""
    return max(1, BLOCK_BYTES // (8 * (width + 1)))


def row_blocks(df: DataFrame, group: str, design: M.Design, label: str, groups) -> DataFrame:
    """The rows of ``groups`` as a written table of blocks: group, labels and packed rows as bytes of doubles, row by row.

    IRLS reads all rows once a step.  A block goes through the JVM as it is, where rows
    would be decoded, packed and copied one by one in every step.  A block has at most
    ``BLOCK_BYTES`` (one row at least), so tasks hold as much of a large table as of a small one.
    """
    width, wanted = len(design.numerics) + len(design.coded), set(groups)
    most = _block_rows(width)

    def part(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            cut = [(g, y[rows].tobytes(), x[rows].tobytes()) for g, at in by_group(batch.column(0)) if g in wanted
                   for rows in (at[i:i + most] for i in range(0, len(at), most))]
            names, labels, packed = zip(*cut) if cut else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(labels, pa.binary()),
                                              pa.array(packed, pa.binary())], names=["g", "y", "x"])
    return materialize(_rows(df, group, design, label).mapInArrow(part, "g string, y binary, x binary"), "row-blocks",
                       row_group=ROW_GROUP)


def _runs(batches, width: int):
    """(group, labels, packed rows) of neighbouring blocks of a group, about ``STEP_ROWS`` rows at a time."""
    blocks = max(1, STEP_ROWS // _block_rows(width))
    for batch in batches:
        for low in range(0, batch.num_rows, blocks):
            held = zip(*[column.to_pylist() for column in batch.slice(low, blocks).columns])
            for g, run in itertools.groupby(held, key=lambda block: block[0]):
                _, labels, packed = zip(*run)
                y = np.frombuffer(b"".join(labels))
                yield g, y, np.frombuffer(b"".join(packed)).reshape(len(y), width)


def _accumulate(blocks: DataFrame, design: M.Design, betas: dict, p: int) -> dict:
    """One pass of IRLS over ``row_blocks``: per group n, X'WX, X'Wz, deviance, sum y at the group's coefficients."""
    upper = np.triu_indices(p)
    shape = M.Design(numerics=design.numerics, coded=design.coded, names=design.names, parts=design.parts)
    width = len(design.numerics) + len(design.coded)

    def part(batches):
        state: dict = {}
        for g, yg, packed in _runs(batches, width):
            if g not in betas:
                continue
            Xg = shape.matrix(packed)
            eta = np.clip(Xg @ betas[g], -500, 500)
            mu = 1.0 / (1.0 + np.exp(-eta))
            w = np.clip(mu * (1 - mu), 1e-300, None)
            mu_c = np.clip(mu, 1e-300, 1 - 1e-16)
            deviance = -2.0 * np.sum(yg * np.log(mu_c) + (1 - yg) * np.log1p(-mu_c))
            # X'Wz without z, whose residual part overflows where the weight vanishes
            v = np.concatenate([[len(yg)], (Xg.T @ (Xg * w[:, None]))[upper],
                                Xg.T @ (w * eta + yg - mu), [deviance, yg.sum()]])
            state[g] = state[g] + v if g in state else v
        if state:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(state), pa.string()), pa.array([v.tolist() for v in state.values()], pa.list_(pa.float64()))],
                names=["g", "s"])

    cells = (blocks.mapInArrow(part, "g string, s array<double>")
             .select("g", F.posexplode("s").alias("at", "v"))
             .groupBy("g", "at").agg(F.sum("v").alias("v")))
    sums: dict[str, np.ndarray] = {}
    m = len(upper[0])
    for r in cells.collect():   # groups x (p(p+1)/2 + p + 3) numbers
        sums.setdefault(r["g"], np.zeros(m + p + 3))[r["at"]] = r["v"]
    out = {}
    for g, s in sums.items():
        gram = np.zeros((p, p))
        gram[upper] = s[1:1 + m]
        out[g] = (s[0], gram + np.triu(gram, 1).T, s[1 + m:1 + m + p], s[1 + m + p], s[2 + m + p])
    return out


def grouped_ols(df: DataFrame, group: str, design: M.Design, label: str = "current_DEP_DELAY") -> dict:
    """Per group: n, beta, se, r2 and the kept columns; null (NaN) entries for dropped columns."""
    p = len(design.names) + 1
    factors = _factor_columns(design)
    res = {}
    for g, (n, xtx, xty, yty, sy) in gram_sums(df, group, design, label).items():
        keep = _keep_columns(xtx, n, factors)
        beta, se = np.full(p, np.nan), np.full(p, np.nan)
        beta[keep], spread = solve_kept(xtx, xty, keep)
        rss = max(yty - float(beta[keep] @ xty[keep]), 0.0)
        dfr = int(n) - int(keep.sum())
        if dfr > 0:
            se[keep] = np.sqrt(spread * rss / dfr)
        tss = yty - sy * sy / n
        res[g] = {"n": n, "beta": beta, "se": se, "rss": rss, "r2": 1 - rss / tss if tss > 0 else math.nan, "df_resid": dfr,
                  "keep": keep, "ci_mult": M.t_quantile(0.975, dfr), "mean_target": sy / n}
    return res


def grouped_logit(df: DataFrame, group: str, design: M.Design, label: str = "current_dep_delayed_15",
                  max_iter: int = 100, tol: float = 1e-10, keeps: dict | None = None) -> dict:
    """Per group: the same, with deviances and ``converged``.

    ``keeps``: per-group column masks (e.g. from ``grouped_ols``).  Without them the
    sums of X'X by level give the masks and also the first step, which starts at
    zero, where every weight is a quarter.  A step that raises a group's deviance
    is halved until it does not, so Newton steps that overshoot still reach the
    maximum.  A group whose weights vanish (perfect separation) stops unconverged.
    Errors come from the weights of the last pass, a step below ``tol`` from the estimates.
    """
    p = len(design.names) + 1
    factors = _factor_columns(design)
    start = None
    if keeps is None:
        start = gram_sums(df, group, design, label)
        keeps = {g: _keep_columns(v[1], v[0], factors) for g, v in start.items()}
    betas = {g: np.zeros(p) for g in keeps}  # to be tried in the next pass
    best: dict[str, tuple] = {}  # least deviance so far, its coefficients, rows, X'WX and sum y
    halved = dict.fromkeys(keeps, 0)
    going, converged = set(keeps), dict.fromkeys(keeps, False)
    blocks = None
    for step in range(max_iter):
        if not going:
            break
        if step == 0 and start is not None:
            sums = {g: (n, gram / 4, xty - gram[0] / 2, 2 * n * math.log(2), sy)
                    for g, (n, gram, xty, _, sy) in start.items()}
        else:
            if blocks is None:
                blocks = row_blocks(df, group, design, label, keeps)
            sums = _accumulate(blocks, design, {g: betas[g] for g in going}, p)
        for g, (n, xwx, xwz, dev, sy) in sums.items():
            k, tried = keeps[g], betas[g]
            if g in best and not dev <= best[g][0] + 1e-9 * (abs(best[g][0]) + 0.1):
                halved[g] += 1  # the step raised the deviance: go half of it
                if halved[g] > MOST_HALVINGS:
                    going.discard(g)
                betas[g] = (best[g][1] + tried) / 2
                continue
            best[g], halved[g] = (dev, tried, n, xwx, sy), 0
            new = np.zeros(p)
            try:
                new[k] = solve_kept(xwx, xwz, k)[0]
            except np.linalg.LinAlgError:
                new[:] = np.nan
            if not np.isfinite(new).all() or np.abs(new[k]).max() > 1e6:
                going.discard(g)
                continue
            if np.abs(new - tried).max() < tol * max(1.0, np.abs(new).max()):
                converged[g] = True
                going.discard(g)
            betas[g] = new
    res = {}
    for g, (dev, _, n, xwx, sy) in best.items():
        k = keeps[g]
        beta, cov = np.full(p, np.nan), np.full((p, p), np.nan)
        if converged[g]:
            beta[k] = betas[g][k]
            scale = np.sqrt(np.diag(xwx)[k])
            cov[np.ix_(k, k)] = np.linalg.inv(xwx[np.ix_(k, k)] / np.outer(scale, scale)) / np.outer(scale, scale)
        se = np.sqrt(np.diag(cov))
        ybar = sy / n
        null_dev = -2 * (sy * math.log(ybar) + (n - sy) * math.log(1 - ybar)) if 0 < ybar < 1 else 0.0
        res[g] = {"n": n, "beta": beta, "se": se, "deviance": dev, "null_deviance": null_dev,
                  "aic": dev + 2 * int(k.sum()), "ci_mult": M.Z975, "mean_target": ybar, "converged": converged[g],
                  "cov": cov}
    return res


def fit_ols(df: DataFrame, design: M.Design, label: str = "current_DEP_DELAY", model: str = "linear") -> M.FitResult:
    """One pooled OLS with t-based errors and the likelihood metrics of its residuals."""
    fit = grouped_ols(df.withColumn("_all", F.lit("all")), "_all", design, label)["all"]
    n, k = fit["n"], int(fit["keep"].sum())
    likelihood = -n / 2.0 * (math.log(2 * math.pi) + math.log(max(fit["rss"], 1e-300) / n) + 1.0)
    r2 = fit["r2"]
    metrics = {"model": model, "n_obs": n, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / max(n - k, 1),
               "aic": -2 * likelihood + 2 * k, "bic": -2 * likelihood + k * math.log(n), "df_resid": fit["df_resid"]}
    p = [M.t_tail(b / e, fit["df_resid"]) if e > 0 else math.nan for b, e in zip(fit["beta"], fit["se"])]
    return M.FitResult(model, ["Intercept", *design.names], fit["beta"].tolist(), fit["se"].tolist(), p,
                       fit["ci_mult"], metrics)


def fit_logit(df: DataFrame, design: M.Design, label: str = "current_dep_delayed_15",
              model: str = "logistic") -> M.FitResult:
    """One pooled logit with the covariance of its estimates; without a maximum they are NaN (``converged`` False)."""
    fit = grouped_logit(df.withColumn("_all", F.lit("all")), "_all", design, label)["all"]
    metrics = {"model": model, "n_obs": fit["n"], "aic": fit["aic"], "deviance": fit["deviance"],
               "null_deviance": fit["null_deviance"], "mean_target": fit["mean_target"], "converged": fit["converged"]}
    return M.FitResult(model, ["Intercept", *design.names], fit["beta"].tolist(), fit["se"].tolist(),
                       [math.erfc(abs(x) / math.sqrt(2)) for x in fit["beta"] / fit["se"]], M.Z975, metrics,
                       cov=fit["cov"])


def predict(df: DataFrame, design: M.Design, fit: M.FitResult, label: str = "current_dep_delayed_15") -> DataFrame:
    """(label, prediction) of a fitted logit."""
    scored = grouped_scores(df.withColumn("_all", F.lit("all")), "_all", design, {"all": np.array(fit.estimates)}, label)
    return scored.select("label", F.col("score").alias("prediction"))


def grouped_scores(df: DataFrame, group: str, design: M.Design, betas: dict,
                   label: str = "current_dep_delayed_15") -> DataFrame:
    """(g, score, label) with each group's own fitted probability; dropped columns count as zero."""
    filled = {g: np.nan_to_num(b) for g, b in betas.items()}

    def run(state, groups, X, y):
        if groups is None:
            return None
        eta = np.empty(len(y))
        for g, at in by_group(groups):
            eta[at] = X[at] @ filled[g]
        return pa.RecordBatch.from_arrays([groups, pa.array(1 / (1 + np.exp(-eta))), pa.array(y)],
                                          names=["g", "score", "label"])

    rows = _rows(df, group, design, label).where(F.col("g").isin(list(filled)))
    return design_batches(rows, design, run, "g string, score double, label double")


PERIOD_TABLE = (
    "period string, status string, n_modeling_pairs long, linear_coef double, linear_ci_lower double, "
    "linear_ci_upper double, minutes_carried_per_10_min double, linear_r_squared double, "
    "logistic_coef double, logistic_or_per_10_min double, logistic_or10_ci_lower double, "
    "logistic_or10_ci_upper double, logistic_auc double, logistic_average_precision double, "
    "current_delay_rate_gt15 double")


def period_table(spark: SparkSession, mf: DataFrame, design: M.Design, period_col: str,
                 min_rows: int = S.MIN_MODEL_ROWS) -> DataFrame:
    """One row per period: n, linear beta/CI/10*beta/R^2, logit beta/OR10/CI, AUC, AP, delay rate.

    ``status`` is ``ok``; ``too few rows`` (below ``min_rows``: no fit is
    reported); ``no previous delay`` (it does not vary); or ``not converged``
    (the logit ended without a maximum).  What could not be fitted is null.
    """
    col = 1 + design.names.index(M.PREV)
    lin = grouped_ols(mf, period_col, design)
    large = {g for g, fit in lin.items() if fit["n"] >= min_rows}
    sized = mf.where(F.col(period_col).cast("string").isin(list(large)))
    logit = grouped_logit(sized, period_col, design, keeps={g: lin[g]["keep"] for g in large}) if large else {}
    done = {g: fit["beta"] for g, fit in logit.items() if fit["converged"]}
    ranks = {}
    if done:
        scores = grouped_scores(sized, period_col, design, done)
        ranks = {r["g"]: (r["roc_auc"], r["average_precision"])
                 for r in ME.ranking_metrics(scores, "score", "label", by=["g"]).collect()}

    def known(x):
        return float(x) if x is not None and math.isfinite(x) else None

    rows = []
    for g in sorted(lin):
        a, b = lin[g], logit.get(g)
        status = ("too few rows" if g not in large else "no previous delay" if not a["keep"][col]
                  else "ok" if b["converged"] else "not converged")
        lb, lse = (a["beta"][col], a["se"][col]) if g in large else (math.nan, math.nan)
        gb, gse = (b["beta"][col], b["se"][col]) if b else (math.nan, math.nan)
        half, wide = a["ci_mult"] * lse, M.Z975 * gse
        rows.append((g, status, int(a["n"]), *map(known, (
            lb, lb - half, lb + half, 10 * lb, a["r2"] if g in large else None, gb, np.exp(10 * gb),
            np.exp(10 * (gb - wide)), np.exp(10 * (gb + wide)), *ranks.get(g, (None, None)))),
            float(b["mean_target"]) if b else None))
    return spark.createDataFrame(rows, PERIOD_TABLE)
