"""Cluster (tail) bootstrap in one data pass.

* Cluster weights: for replicate r, draw T tails with replacement out of the T
  tails (draw j of replicate r picks tail index md5(r|seed|j) mod T), then count
  draws per tail.  Tails get dense sorted indices without a single-task window
  (range partitioning + partition offsets over a checkpointed tail table).
* beta: a frequency-weighted least-squares fit only needs the weighted sums of
  the per-tail Gram blocks, sum_t c_rt * [X_t'X_t, X_t'y_t].  The Gram blocks are
  built once, in rows gathered by tail (large tails in parts), then each block of
  tails multiplies its replicate x tail count matrix by its Gram matrix
  (cogroup by tail block), the partial sums are added cell by cell per replicate
  and each replicate solves p x p.  Cost: one pass over the rows for any number of
  replicates; no row is weighted or copied per replicate.
* lambda: the tail-leg summary joined to the counts, weighted leg means per
  replicate and the grouped exponential fit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knockon.operators import decay as D
from knockon.operators import features as FE
from knockon.operators import grouped as G
from knockon.operators import models as M
from knockon.session import materialize

# ------------------------------------------------------------------ cluster weights


def dense_index(keys: DataFrame, key: str, n_ranges: int | None = None) -> DataFrame:
    """(key, idx) with idx = 0-based rank of key in sorted order, computed distributed.

    Keys are range-partitioned and checkpointed (so partition ids are fixed), each
    partition counts its keys, the small count table is prefix-summed, and each
    key's index is its partition offset plus its rank inside the partition.
    """
    n_ranges = n_ranges or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = (keys.select(key).distinct().repartitionByRange(n_ranges, key)
              .sortWithinPartitions(key).checkpoint(eager=True))  # partition ids must not change between reads
    tagged = ranged.withColumn("_pid", F.spark_partition_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_pid").orderBy(key)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .select(key, (F.col("_off") + F.row_number().over(within) - 1).cast("long").alias("idx")))


def draw_index(rep, seed: int, j, n) -> F.Column:
    """Tail index of draw j in replicate rep: first 60 bits of md5(rep|seed|j) mod n."""
    h = F.md5(F.concat_ws("|", rep.cast("string"), F.lit(str(seed)), j.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.lit(n))


def cluster_weights(tails: DataFrame, n_reps: int, seed: int, key: str = "TAIL_NUM") -> DataFrame:
    """(replicate, key, bootstrap_count) for tails drawn at least once."""
    index = dense_index(tails, key)
    n = index.count()
    if n == 0:
        raise ValueError("the cluster bootstrap needs at least one tail, found none")
    spark = tails.sparkSession
    draws = spark.range(0, n_reps * n).select(
        (F.col("id") / F.lit(n)).cast("long").alias("replicate"),
        (F.col("id") % F.lit(n)).alias("j"))
    picked = draws.select("replicate", draw_index(F.col("replicate"), seed, F.col("j"), n).alias("idx"))
    counts = picked.groupBy("replicate", "idx").agg(F.count(F.lit(1)).alias("bootstrap_count"))
    return counts.join(index, "idx").select(F.col("replicate").cast("int").alias("replicate"), key,
                                            "bootstrap_count")


def poisson_thresholds() -> list[float]:
    """Cumulative Poisson(1) probabilities P(X <= k), up to the last below 1 at the 52 bits of the hash."""
    out, term, total, k = [], math.exp(-1.0), 0.0, 0
    while term > 2.0 ** -53:
        total += term
        out.append(total)
        k += 1
        term /= k
    return out


def hash_uniform(*parts) -> F.Column:
    """Uniform [0, 1) from the first 52 bits of md5(parts joined by '|')."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def poisson_weights(tails: DataFrame, n_reps: int, seed: int, key: str = "TAIL_NUM") -> DataFrame:
    """(replicate, key, bootstrap_count) with independent Poisson(1) counts per tail and
    replicate (inverse CDF of a hash uniform): the large-T form of the cluster bootstrap.
    Needs no tail ranking and no draw table; zero counts are omitted."""
    u = hash_uniform(F.col("replicate"), F.lit(str(seed)), F.col(key))
    count = None
    for k, c in enumerate(poisson_thresholds()):
        count = F.when(u < F.lit(c), F.lit(k)) if count is None else count.when(u < F.lit(c), F.lit(k))
    count = count.otherwise(F.lit(len(poisson_thresholds())))
    per_tail = tails.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))).alias("replicate"))
    return (per_tail.select("replicate", key, count.cast("long").alias("bootstrap_count"))
            .where(F.col("bootstrap_count") > 0))


def row_weights(rows: DataFrame, weights: DataFrame, replicate: int, key: str = "TAIL_NUM") -> DataFrame:
    """Rows of one replicate with their tail's count as weight (missing -> 0, kept if > 0)."""
    w = weights.where(F.col("replicate") == replicate).select(key, "bootstrap_count")
    return (rows.join(w, key, "left")
            .withColumn("weight", F.coalesce(F.col("bootstrap_count"), F.lit(0)).cast("double"))
            .where(F.col("weight") > 0).drop("bootstrap_count"))


# ------------------------------------------------------------------ beta via Gram blocks

def bootstrap_design(mf: DataFrame, single: bool = False):
    """Bootstrap design: prev + numeric controls + carrier, year, month, weekday and
    period factors (period as plain text, so its base level is alphabetical)."""
    if single:
        return M.build_design({}, [], [])
    factors = ["OP_UNIQUE_CARRIER", "current_year", "current_month", "current_day_of_week",
               "dep_period"]
    levels = M.factor_levels(mf, factors)
    levels["dep_period"] = sorted(levels["dep_period"])
    return M.build_design(levels, factors, M.NUMERIC_CONTROLS)


#: Tails with more than this share of all rows are gathered in parts; at most 1 / LARGE_TAIL tails are so large.
LARGE_TAIL = 1e-3


def gathered_by_tail(rows: DataFrame, key: str = "k") -> DataFrame:
    """Rows shuffled and sorted by tail; a large tail goes to as many tasks as it is times too large."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(1, int(total * LARGE_TAIL))
    large = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("long").alias("parts"))
    # at most 1 / LARGE_TAIL keys
    spread = rows.join(F.broadcast(large), key, "left").withColumn("part", F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64("y", "x"), F.col("parts"))).otherwise(0)).drop("parts")
    return spread.repartition(key, "part").sortWithinPartitions(key, "part")


def tail_grams(mf: DataFrame, design, key: str = "TAIL_NUM", label: str = "current_DEP_DELAY") -> DataFrame:
    """Packed sums [n, X'X (upper), X'y, y'y] with X = [1, design]: a row per tail, several for large tails.

    Rows come sorted by tail, so a task holds the sums of one tail at a time.
    """
    p = len(design.names) + 1
    means = mf.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(design.exprs)]).first()
    centre = np.array([0.0, *[float(means[f"m{i}"] or 0.0) for i in range(len(design.exprs))]])
    rows = mf.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"),
                     design.packed().alias("x")).where(F.col("k").isNotNull())
    upper = np.triu_indices(p)

    def batch_of(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done]), pa.array([v.tolist() for _, v in done], pa.list_(pa.float64()))],
            names=["k", "s"])

    def run(state, tails, X, y):
        done = []
        if tails is None:
            return batch_of(list(state.items())) if state else None
        X -= centre
        for tail, at in G.by_group(tails):
            Xt, yt = X[at], y[at]
            v = np.concatenate([[len(at)], (Xt.T @ Xt)[upper], Xt.T @ yt, [yt @ yt]])
            if tail in state:
                state[tail] = state[tail] + v
            else:
                done.extend(state.items())
                state.clear()
                state[tail] = v
        return batch_of(done) if done else None

    return G.design_batches(gathered_by_tail(rows).select("k", "y", "x"), design, run,
                            "k string, s array<double>").withColumnRenamed("k", key)


def _unpack(s: np.ndarray, p: int):
    m = p * (p + 1) // 2
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = s[1:1 + m]
    g = g + np.triu(g, 1).T
    return g, s[1 + m:1 + m + p]


def bootstrap_beta(mf: DataFrame, weights: DataFrame, design=None, key: str = "TAIL_NUM",
                   n_blocks: int | None = None) -> DataFrame:
    """(replicate, beta_prev_arr_delay) from the weighted Gram sums (one data pass)."""
    design = design or bootstrap_design(mf)
    p = len(design.names) + 1
    col = 1 + design.names.index(M.PREV)
    grams = tail_grams(mf, design, key)
    if n_blocks is None:
        n_blocks = max(1, int(weights.select(key).distinct().count() // 2000) + 1)
    blk = F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("_blk")
    g = grams.select(blk, key, "s")
    w = weights.select(blk, key, "replicate", "bootstrap_count")

    def combine(gp: pd.DataFrame, wp: pd.DataFrame) -> pd.DataFrame:
        if len(gp) == 0 or len(wp) == 0:
            return pd.DataFrame({"replicate": pd.Series([], dtype="int32"), "s": []})
        counts = wp.pivot(index="replicate", columns=key, values="bootstrap_count")
        per_row = counts.reindex(columns=gp[key]).fillna(0).to_numpy(float)  # a column per Gram row
        return pd.DataFrame({"replicate": counts.index.to_numpy("int32"),
                             "s": list(per_row @ np.vstack(gp["s"].to_numpy()))})

    part = g.groupBy("_blk").cogroup(w.groupBy("_blk")).applyInPandas(
        combine, "replicate int, s array<double>")
    cells = (part.select("replicate", F.posexplode("s").alias("at", "v"))
             .groupBy("replicate", "at").agg(F.sum("v").alias("v")))
    sums = cells.groupBy("replicate").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c.v).alias("s"))  # p(p+1)/2 + p + 2 cells

    def solve(batches):
        for batch in batches:
            beta = [np.linalg.lstsq(*_unpack(np.asarray(s), p), rcond=None)[0][col] for s in batch["s"]]
            yield pd.DataFrame({"replicate": batch["replicate"], "beta_prev_arr_delay": beta})

    return sums.mapInPandas(solve, "replicate int, beta_prev_arr_delay double")


# ------------------------------------------------------------------ lambda


def bootstrap_leg_means(tail_summary: DataFrame, weights: DataFrame, key: str = "TAIL_NUM") -> DataFrame:
    """Per (replicate, leg): weight = n_obs * count, weighted mean of tail means."""
    j = tail_summary.join(weights, key, "inner").withColumn(
        "weight", F.col("n_obs") * F.col("bootstrap_count"))
    return (j.groupBy("replicate", "leg_index")
            .agg(F.sum("weight").alias("n_obs"),
                 (F.sum(F.col("weight") * F.col("mean_remaining_delay")) / F.sum("weight"))
                 .alias("mean_remaining_delay")))


def bootstrap_lambda(tail_summary: DataFrame, weights: DataFrame, key: str = "TAIL_NUM") -> DataFrame:
    fit = D.fit_groups(bootstrap_leg_means(tail_summary, weights, key), ["replicate"])
    return fit.select("replicate", F.nanvl("lambda", F.lit(None).cast("double")).alias("lambda_decay"))


def bootstrap_table(beta: DataFrame, lam: DataFrame | None, seed: int) -> DataFrame:
    out = beta if lam is None else beta.join(lam, "replicate", "left")
    out = out.withColumn("seed", F.lit(int(seed)))
    cols = ["replicate", "seed", "beta_prev_arr_delay"] + ([] if lam is None else ["lambda_decay"])
    return out.select(*cols)


def bootstrap_ci(table: DataFrame, cols: list[str]) -> DataFrame:
    """2.5 / 97.5 percentiles (linear interpolation, nulls ignored) of each column."""
    aggs = []
    for c in cols:
        q = F.percentile(F.nanvl(F.col(c), F.lit(None).cast("double")), [0.025, 0.975])
        aggs += [q[0].alias(f"{c}_ci_lower"), q[1].alias(f"{c}_ci_upper")]
    return table.agg(*aggs)


def run_bootstrap(spark: SparkSession, mf: DataFrame, tail_summary: DataFrame | None,
                  n_reps: int, seed: int, scheme: str = "multinomial", single: bool = False) -> DataFrame:
    """replicate, seed, beta_prev_arr_delay[, lambda_decay].  ``single``: no controls in the regression.

    ``scheme``: "multinomial" draws T tails with replacement per replicate (the
    classic cluster bootstrap); "poisson" gives each tail an independent
    Poisson(1) count (no ranking, no draw table: the form for very many tails)."""
    # read by the weights, the means, the levels and the Grams
    mf = materialize(mf.select("TAIL_NUM", *FE.MODEL_COLUMNS), "bootstrap-frame")
    if tail_summary is not None:
        tail_summary = materialize(tail_summary, "tail-legs")
    make = poisson_weights if scheme == "poisson" else cluster_weights
    w = materialize(make(mf.where(F.col("TAIL_NUM").isNotNull()), n_reps, seed), "weights")
    beta = bootstrap_beta(mf, w, bootstrap_design(mf, single))
    lam = bootstrap_lambda(tail_summary, w) if tail_summary is not None else None
    return bootstrap_table(beta, lam, seed)
