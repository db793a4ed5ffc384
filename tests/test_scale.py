"""Plans and session settings that keep the queries' work in step with their input."""

import re

from pyspark.sql import functions as F

from knockon.functions import scalar as X
from knockon.operators import features as FE
from knockon.operators import pairs as P
from knockon.plans import catalog as K
from knockon.session import COMPILED_BYTES, METHOD_LIMIT, ensure_compiled, materialize


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_source_names_are_matched_on_months_only(spark, sf_dir):
    assert "lineitem" not in _plan(K.QUERIES["source_pick"](spark, sf_dir))


def test_values_of_columns_are_counted_without_copies_of_the_row(spark):
    rows = spark.createDataFrame([("a", "", "xyz"), ("b", "", "x"), ("a", None, "x")], "p string, q string, r string")
    got = K.column_values(rows.na.fill(""), ["p", "q", "r"])
    assert got.first().asDict() == {
        "n_rows": 3, "n_p": 2, "len_p": 3, "min_p": "a", "max_p": "b", "n_q": 1, "len_q": 0, "min_q": "", "max_q": "",
        "n_r": 2, "len_r": 5, "min_r": "x", "max_r": "xyz"}
    assert "Expand" not in _plan(got)
    none = K.column_values(rows.limit(0), ["p"]).first()
    assert tuple(none) == (0, 0, None, None, None)


def test_sessions_made_elsewhere_run_large_stages_by_operator():
    from unittest import mock
    for chosen in (False, True):
        session = mock.Mock()
        session.sparkContext.getConf.return_value.contains.return_value = chosen
        ensure_compiled(session)
        assert session.conf.set.call_args_list == ([] if chosen else [mock.call(METHOD_LIMIT, COMPILED_BYTES)])


def test_dates_are_those_of_the_pattern(spark):
    texts = ["2024-01-02", " 2024-01-02 ", "2024-1-2", "2024/1/02", "20240102", "1/2/2024", "1/2/2024 12:00:00 AM",
             "2024-01-02T10:00:00Z", "2024-01-2T", "2024-01-2 ", "2024-01-2\x00", "2024-01-T2", "2024-1-2 x",
             "2024-1T-02", "+024-01-02", "2024-13-01", "2024-02-30", "0000-01-01", "2024", "2024-01", "", "x\n2024-01-02",
             "2024-01-02 x", "2024-01-0٢", "　2024-01-02", "2024-01-02\n", "a\nb", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    text = X.strip("t")
    want = F.when(text.rlike(X._DATE), F.regexp_replace(text, X._DATE, X._ISO).try_cast("date"))
    assert rows.where(~X.parse_date("t").eqNullSafe(want)).collect() == []


def test_schedule_is_derived_in_few_steps(spark):
    from knockon.operators import clean as C
    clocks = [None, -5.0, -1.0, -0.5, 0.0, 5.0, 59.0, 60.0, 100.9, 1275.0, 2359.0, 2360.0, 2399.5, 2400.0, 2400.5, 2401.0, 1e12,
              float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(d, a, b) for d in ("2024-02-28", None) for a in clocks for b in clocks],
                                 "d string, CRS_DEP_TIME double, CRS_ARR_TIME double").select(
        F.col("d").cast("date").alias("FL_DATE"), "CRS_DEP_TIME", "CRS_ARR_TIME", F.lit("A").alias("ORIGIN"), F.lit("B").alias("DEST"))
    got = C.derive_schedule(rows)
    dep, arr = (X.hhmm_timestamp("FL_DATE", c) for c in ("CRS_DEP_TIME", "CRS_ARR_TIME"))
    same = (F.col("sched_dep_timestamp").eqNullSafe(dep) & F.col("sched_arr_timestamp").eqNullSafe(X.overnight_fix(dep, arr))
            & F.col("sched_dep_hour").eqNullSafe(X.hhmm_hour("FL_DATE", "CRS_DEP_TIME"))
            & F.col("sched_arr_hour").eqNullSafe(X.hhmm_hour("FL_DATE", "CRS_ARR_TIME")))
    assert got.where(~same).collect() == [] and got.where("sched_arr_timestamp is not null").count() == 160
    assert dict(got.dtypes)["sched_dep_hour"] == "int" and dict(got.dtypes)["sched_arr_timestamp"] == "timestamp_ntz"
    assert _plan(got).count("Project") <= 3


def test_clean_step_of_the_pairs_is_small_enough_to_be_compiled(spark, sf_dir):
    kept = K.clean_of(spark, sf_dir, "lineitem").select(*K.ids("lineitem"), *P.PAIR_INPUTS)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= int(COMPILED_BYTES)


def test_model_frames_shuffle_only_what_they_read(spark):
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    clean = spark.range(10).select(
        "id", *[F.lit("A").alias(c) for c in ("TAIL_NUM", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "route")],
        *[F.lit(1.0).alias(c) for c in ("DEP_DELAY", "ARR_DELAY", "DISTANCE")], F.lit(1).alias("sched_dep_hour"),
        day.cast("date").alias("FL_DATE"), F.timestamp_add("HOUR", F.col("id") * 2, day).alias("sched_dep_timestamp"),
        F.timestamp_add("HOUR", F.col("id") * 2 + 1, day).alias("sched_arr_timestamp"))
    frame = FE.model_frame(P.flight_pairs(K.materialize(clean), ["id"], split=None))
    plan = _plan(frame)
    assert frame.count() == 9 and "Window" in plan and "struct(" not in plan.replace("ReadSchema: struct", "")
    assert "route" not in plan


def test_numbers_are_those_of_the_pattern(spark):
    texts = ["5", "-3.50", "+7", ".5", "5.", "1e5", "1E-3", "1e400", "-.5e2", "5D", "5f", "0x10", "0X1p3", "-0x1P3", "1d5", "5 5", " 5", "5 ",
             "\x005", "5\x00", "\t5", "5\n", ",5", "/5", "1,000", "1_000", "--5", "+-5", "-", ".", "+", "", " ", "٥", "5٥", "１", "　5",
             "nan", "inf", "-Infinity", "+inf", "infinity5", "NaN5", "5e", "e5", "1.2.3", "-0", "1" * 400, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    text = X.strip("t")
    want = F.when(text.rlike(X._NUMBER), text).try_cast("double")
    assert rows.where(~X.coerce_double("t").eqNullSafe(F.nanvl(want, F.lit(None).cast("double")))).collect() == []
    plan = _plan(rows.select(X.coerce_double("t").alias("n")))
    assert "substring(t" in plan and plan.index("substring(t") < plan.index("RLIKE")  # usual numbers skip the pattern


def test_mixed_layouts_are_written_from_one_reading_of_the_fixture(spark, sf_dir, monkeypatch):
    stages = []
    monkeypatch.setattr(K, "materialize", lambda df, name="stage": stages.append(name) or materialize(df, name))
    K._write_mixed(spark, sf_dir)
    assert stages == ["raw-long"]


def test_tail_and_date_are_derived_once(spark, sf_dir):
    plan = _plan(K.clean_of(spark, sf_dir, "lineitem"))
    assert plan.count("RLIKE(") == 1 and plan.count("date_trunc(") == 1
    assert "trim(concat" not in plan  # the filter names the derived columns, not what they are made of


def test_visible_ends_keep_their_text(spark):
    ends = [*X.SPACES, "a", "!", "~", "\x7f", "\x00", "é", "中", ""]
    rows = spark.createDataFrame([(a + m + b,) for a in ends for m in ("", "N 1", " ") for b in ends] + [(None,)], "t string")
    assert rows.where(~X.strip("t").eqNullSafe(F.btrim("t", F.lit(X.SPACES)))).collect() == []


def test_pairs_from_minutes_are_those_from_timestamps(spark):
    from knockon.operators import clean as C
    days, clocks = ["2024-02-28", "2024-02-29", "1969-12-31", None], [None, 0.0, 30.0, 915.0, 1130.0, 1275.0, 2359.0, 2400.0]
    flights = [(f"N{i % 2}" if i % 9 else None, day, "C1", "A" if i % 3 else None, "A" if i % 4 else "B", dep, arr, float(i % 40), 3.0, 100.0)
               for i, (day, dep, arr) in enumerate((d, a, b) for d in days for a in clocks for b in clocks)]
    rows = spark.createDataFrame(flights, "TAIL_NUM string, d string, OP_UNIQUE_CARRIER string, ORIGIN string, DEST string, "
                                 "CRS_DEP_TIME double, CRS_ARR_TIME double, DEP_DELAY double, ARR_DELAY double, DISTANCE double")
    rows = rows.withColumn("FL_DATE", F.col("d").cast("date")).withColumn("id", F.monotonically_increasing_id())
    rows = K.materialize(rows)
    for split in (None, "auto"):
        want, got = (P.pair_candidates(C.derive_schedule(rows, epoch), ["id"], split, ["id"], 2) for epoch in (False, True))
        assert want.schema == got.schema and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert got.where("scheduled_turnaround_minutes is not null and prev_sched_arr_timestamp < timestamp_ntz'1970-01-02'").count()
    plan = _plan(FE.model_frame(P.flight_pairs(C.derive_schedule(rows, True), ["id"], None)))
    assert "timestampdiff" not in plan and "timestampadd" not in plan


def test_logit_packs_its_rows_once(spark, monkeypatch):
    from knockon.operators import grouped as G
    from knockon.operators import models as M
    rows = K.materialize(spark.range(400).select(
        F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("g"),
        ((F.col("id") * 37) % 101).cast("double").alias(M.PREV), (F.col("id") % 5).cast("string").alias("f"),
        ((F.col("id") * 29) % 7 < 3).cast("int").alias("current_dep_delayed_15")))
    design = M.build_design({"f": list("01234")}, ["f"], [])
    calls, packed = [], M.Design.packed
    monkeypatch.setattr(M.Design, "packed", lambda self: calls.append(1) or packed(self))
    fits = G.grouped_logit(rows, "g", design)
    assert set(fits) == {"g0", "g1", "g2", "g3"} and all(f["converged"] and f["n"] == 100 for f in fits.values())
    assert len(calls) == 1  # several steps, one packing
    for g, fit in fits.items():  # the maximum: the score is zero
        at = [r for r in rows.collect() if r.g == g]
        x = [[1.0, r[M.PREV], *[float(r.f == v) for v in "1234"]] for r in at]
        p = [1 / (1 + 2.718281828459045 ** -sum(b * v for b, v in zip(fit["beta"], row))) for row in x]
        assert all(abs(sum(row[j] * (r.current_dep_delayed_15 - q) for row, r, q in zip(x, at, p))) < 1e-6 for j in range(6))
    blocks = G.row_blocks(rows, "g", M.Design(), "current_dep_delayed_15", ["g1"]).collect()  # no columns: labels alone
    assert sum(len(b.y) for b in blocks) == 800 and {b.g for b in blocks} == {"g1"} and not any(b.x for b in blocks)


def test_blocks_of_a_large_partition_stay_small(spark, monkeypatch):
    import numpy as np
    import pyarrow.parquet as pq
    from knockon.operators import grouped as G
    from knockon.operators import models as M
    rows = spark.range(30_000, numPartitions=1).select(
        F.when(F.col("id") % 50 == 0, "few").when(F.col("id") % 3 == 0, "some").otherwise("many").alias("g"),
        F.rand(7).alias(M.PREV), F.rand(8).alias("v"), (F.col("id") % 4).cast("string").alias("f"),
        (F.rand(9) < 0.4).cast("int").alias("current_dep_delayed_15")).cache()
    design = M.build_design({"f": list("0123")}, ["f"], ["v"])
    monkeypatch.setattr(G, "ROW_GROUP", 1 << 16, raising=False)
    table = G.row_blocks(rows, "g", design, "current_dep_delayed_15", ["few", "many"])
    blocks = table.collect()
    assert max(len(b.x) + len(b.y) for b in blocks) <= 4096  # readers hold thousands of blocks at once
    assert max(pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in table.inputFiles()) > 1
    kept = [r for r in rows.collect() if r.g != "some"]
    want = {g: np.array([(r.current_dep_delayed_15, r[M.PREV], r.v, int(r.f)) for r in kept if r.g == g]) for g in ("few", "many")}
    for g, w in want.items():  # every row once, label and numbers together
        got = np.concatenate([np.column_stack([np.frombuffer(b.y), np.frombuffer(b.x).reshape(-1, 3)]) for b in blocks if b.g == g])
        assert np.array_equal(got[np.lexsort(got.T)], w[np.lexsort(w.T)])
    beta = {"few": np.linspace(-1, 1, 6), "many": np.linspace(0.5, -0.5, 6)}
    sums = G._accumulate(table, design, beta, 6)
    assert set(sums) == set(want)
    for g, (n, xwx, xwz, deviance, ones) in sums.items():
        y, x = want[g][:, 0], design.matrix(want[g][:, 1:])
        mu = 1 / (1 + np.exp(-x @ beta[g]))
        w = mu * (1 - mu)
        assert n == len(y) and ones == y.sum() and np.isclose(deviance, -2 * np.sum(np.where(y == 1, np.log(mu), np.log(1 - mu))))
        assert np.allclose(xwx, x.T @ (x * w[:, None])) and np.allclose(xwz, x.T @ (w * (x @ beta[g]) + y - mu))


def test_rows_wider_than_a_block_are_blocks_of_their_own(spark):
    from knockon.operators import grouped as G
    from knockon.operators import models as M
    rows = spark.range(300).select(F.lit("g").alias("g"), F.lit(1).alias("y"),
                                   *[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(600)])
    design = M.build_design({}, [], [f"c{i}" for i in range(600)], include_prev=False)
    blocks = G.row_blocks(rows, "g", design, "y", ["g"]).collect()
    assert len(blocks) == 300 and {len(b.x) for b in blocks} == {4800} and {len(b.y) for b in blocks} == {8}
