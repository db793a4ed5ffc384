"""The whole analysis over monthly files: list, choose, read, clean, pair, fit, report.

Every stage is a Parquet table under the output folder, and each report is a
small CSV folder, so a run can be looked at, or taken up again, stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon.operators import bootstrap as B
from knockon.operators import decay as D
from knockon.operators import features as FE
from knockon.operators import pairs as P
from knockon.operators import reports as R
from knockon.plans import suite as SU
from knockon.session import scratch_path
from knockon.sources import counted as CO
from knockon.sources import files as SRC
from knockon.sources import layout as LAY

#: Orders flights of one tail that leave at the same time.
TIE_BREAK = ("ORIGIN", "DEST", "OP_UNIQUE_CARRIER", "CRS_ARR_TIME")


def chosen_sources(spark: SparkSession, root: str, months: DataFrame | None = None) -> DataFrame:
    """(year, month, path): one file for each month found under ``root``, of the ``months`` if given."""
    picked = SRC.source_pick(SRC.list_files(spark, root))
    return picked if months is None else picked.join(months, ["year", "month"], "left_semi")


def read_sources(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Raw rows of CSV and ZIP months in canonical columns; no month at all is an error."""
    paths = [r.path for r in sources.select("path").orderBy("path").collect()]  # one per month
    if not paths:
        raise FileNotFoundError("no monthly file has a known name")
    archives = [p for p in paths if p.lower().endswith(".zip")]
    tables = [p for p in paths if p not in set(archives)]
    frames = ([SRC.read_month_csv(spark, tables)] if tables else []) + (
        [SRC.read_month_zip(spark, archives).drop("source_path")] if archives else [])
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def chosen_months(spark: SparkSession, start: str | None, end: str | None) -> DataFrame | None:
    """The months to read; None is all.  One end alone is an error, not a wider range."""
    if (start is None) != (end is None):
        raise ValueError(f"a month range needs both ends: start is {start}, end is {end}")
    return None if start is None else SRC.month_range(spark, start, end)


def run_job(spark: SparkSession, root: str, out: str, start: str | None = None, end: str | None = None,
            replicates: int = 0, seed: int = 42, models=SU.MODELS, start_year: int | None = None,
            end_year: int | None = None, windows: list[tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """Run all stages and return the reports by name.

    ``start`` and ``end`` ('YYYY-MM') limit the months read.  ``start_year`` and
    ``end_year`` limit the pairs that are modelled (both included, each may stand
    alone).  ``windows`` asks for fits of the given year ranges, which must not
    overlap.  ``replicates`` asks for bootstrap intervals.  No files, no pairs, or
    no late arrivals is an error.
    """
    months = chosen_months(spark, start, end)
    raw = read_sources(spark, chosen_sources(spark, root, months))
    cleaned = CO.write_clean(raw, f"{out}/clean")
    CO.require_rows(cleaned, "output_rows")
    clean = spark.read.parquet(f"{out}/clean").drop("year")
    path = scratch_path(spark, "by_tail")
    by_tail = LAY.write_chain_layout(clean, path, "by_tail_" + path[-12:], P.chain_order(TIE_BREAK))
    paired = CO.write_pairs(by_tail, f"{out}/pairs", tiebreak=TIE_BREAK, split=LAY.BUCKET)
    CO.require_rows(paired, "output_pairs")
    pairs = SRC.read_pairs(spark, f"{out}/pairs", start_year=start_year, end_year=end_year).drop("current_year")
    frame = FE.model_frame(pairs)
    suite = SU.fit_suite(spark, frame, models=models)
    legs = D.tail_leg_summary(by_tail, tiebreak=TIE_BREAK, split=LAY.BUCKET)
    by_leg = D.decay_by_leg(legs)
    parameters = D.decay_parameters(by_leg)
    totals = R.dataset_totals(clean, pairs)
    interval = None
    reports = {"clean_summary": CO.clean_summary(spark, f"{out}/clean", cleaned),
               "pair_summary": spark.createDataFrame([tuple(paired.values())], ", ".join(f"{c} long" for c in paired)),
               "decay_by_leg": D.decay_table(by_leg), "decay_parameters": parameters,
               "coefficients": suite["coefficients"]}
    if replicates:
        reports["bootstrap"] = B.run_bootstrap(spark, frame, legs, replicates, seed)
        interval = B.bootstrap_ci(reports["bootstrap"], ["beta_prev_arr_delay", "lambda_decay"])
    reports |= {k: suite[k] for k in ("airline_carryover", "turnaround_carryover", "main_result", "secondary_result")
                if k in suite}
    if "main_result" in suite:
        reports["final_summary"] = R.final_summary(totals, suite["coefficients"], suite["main_result"], parameters, interval)
        reports["presentation_metrics"] = R.presentation_metrics(spark, suite["main_result"], suite["metrics"])
    reports["periods"] = SU.fit_periods(spark, frame, SU.yearly_periods(SU.years_of(frame)))
    if windows:
        reports["windows"] = SU.fit_periods(spark, frame, [(f"{a}-{b}", a, b) for a, b in windows])
    reports["delay_rate_by_bin"] = R.delay_rate_by_bin(frame)
    reports["density_grid"] = R.density_grid(frame, "prev_ARR_DELAY", "current_DEP_DELAY")
    reports["yearly_summary"] = R.yearly_summary(reports["periods"])
    reports["delay_sources"] = clean.groupBy(F.year("FL_DATE").alias("year")).agg(F.count(F.lit(1)).alias("flights"))
    for name, table in reports.items():
        R.write_report(table, f"{out}/reports/{name}")
    return reports
