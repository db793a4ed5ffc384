"""The split (entity, day/hour bucket) chain equals the plain per-entity window."""

from pyspark.sql import functions as F

from knockon.operators import decay as D
from knockon.operators import pairs as P
from knockon.plans import catalog as K


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pairs_split_invariance(spark, sf_dir):
    clean = K.clean_of(spark, sf_dir)
    cols = ["event_id", "prev_ORIGIN", "prev_DEST", "prev_ARR_DELAY", "prev_sched_arr_timestamp",
            "scheduled_turnaround_minutes"]
    base = _rows(P.pair_candidates(clean, ["event_id"], split=None, keep=["event_id"]), cols)
    for split in ("day", "hour"):
        assert _rows(P.pair_candidates(clean, ["event_id"], split=split, keep=["event_id"]), cols) == base


def test_later_legs_split_invariance_and_shuffle(spark, sf_dir):
    clean = K.clean_of(spark, sf_dir)
    cols = ["event_id"] + [f"next_dep_delay_{k}" for k in range(1, 6)]
    base = _rows(D.later_legs(clean, 5, ["event_id"], split=None), cols)
    assert _rows(D.later_legs(clean, 5, ["event_id"], split="day"), cols) == base
    shuffled = clean.repartition(7, F.rand(3))
    assert _rows(D.later_legs(shuffled, 5, ["event_id"], split="hour"), cols) == base


def test_pair_count_invariants(spark, sf_dir):
    s = K.QUERIES["pair_summary"](spark, sf_dir).agg(
        *[F.sum(c).alias(c) for c in ["raw_rows", "candidate_pairs", "same_airport_pairs", "output_pairs"]]
    ).collect()[0]
    assert s.raw_rows >= s.candidate_pairs >= s.same_airport_pairs >= s.output_pairs > 0
