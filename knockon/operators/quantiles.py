"""Exact quantiles of unbounded columns by distributed selection.

``percentile`` merges a value->count map into one task, which holds every distinct
value.  Here the rank of each quantile is narrowed down instead: in every round a
mergeable sketch proposes two values close around the rank, one aggregation
counts the rows below, at, between and above them, and the zone that holds the
rank is searched on.  The sketch only proposes; the counts are exact, and each round takes
at least the two proposed values out of the zone, so ties and any distribution end.
A zone of few rows is sorted within one aggregate.  No row is shuffled; a task
holds a sketch and at most ``small`` values per rank.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knockon.session import materialize

#: Rows of a zone that are sorted in one aggregate.
SMALL_ZONE = 10_000
#: Accuracy of the sketch: its ranks are off by at most 1 / ACCURACY of the zone's rows.
ACCURACY = 10_000


def _inside(zone):
    """Rows strictly between the ends of a zone (None: open)."""
    low, high, _, _ = zone
    test = F.lit(True)
    if low is not None:
        test = test & (F.col("v") > F.lit(low))
    if high is not None:
        test = test & (F.col("v") < F.lit(high))
    return test


def _rows_of(values: DataFrame, zones) -> DataFrame:
    """Only rows of some zone: the comparisons reach the scan."""
    test = F.lit(False)
    for zone in zones:
        test = test | _inside(zone)
    return values.where(test)


def select_ranks(values: DataFrame, ranks: list[int], total: int, small: int = SMALL_ZONE) -> dict[int, float]:
    """Value of each 0-based rank of column ``v`` (doubles, none null or NaN, ``total`` rows)."""
    # a zone: its open ends, the rows below it, the rows inside
    zones = {rank: (None, None, 0, total) for rank in set(ranks)}
    found: dict[int, float] = {}
    while zones:
        little = {rank: z for rank, z in zones.items() if z[3] <= small}
        if little:
            kinds = list(dict.fromkeys(little.values()))
            row = _rows_of(values, kinds).agg(*[
                F.sort_array(F.collect_list(F.when(_inside(z), F.col("v")))).alias(f"s{i}")
                for i, z in enumerate(kinds)]).select(*[
                    F.element_at(f"s{kinds.index(z)}", rank - z[2] + 1).alias(f"r{rank}")
                    for rank, z in little.items()]).first()
            found |= {rank: row[f"r{rank}"] for rank in little}
        zones = {rank: z for rank, z in zones.items() if rank not in found}
        if not zones:
            break
        proposed = _rows_of(values, zones.values()).agg(*[
            F.percentile_approx(F.when(_inside(z), F.col("v")),
                                [max(0.0, (rank - z[2]) / z[3] - 2 / ACCURACY), min(1.0, (rank - z[2]) / z[3] + 2 / ACCURACY)],
                                ACCURACY).alias(f"p{rank}") for rank, z in zones.items()]).first()
        counts = []
        for rank, z in zones.items():
            a, b = (F.lit(x) for x in proposed[f"p{rank}"])
            tests = {"below": F.col("v") < a, "low": F.col("v") == a, "between": (F.col("v") > a) & (F.col("v") < b),
                     "high": (F.col("v") == b) & (F.col("v") > a), "above": F.col("v") > b}
            counts += [F.count_if(_inside(z) & test).alias(f"{name}{rank}") for name, test in tests.items()]
        counted = _rows_of(values, zones.values()).agg(*counts).first()
        for rank, (low, high, before, _) in list(zones.items()):
            a, b = proposed[f"p{rank}"]
            for name, ends in (("below", (low, a)), ("low", a), ("between", (a, b)), ("high", b), ("above", (b, high))):
                n = counted[f"{name}{rank}"]
                if rank < before + n:
                    break
                before += n
            if name in ("low", "high"):
                found[rank] = ends
                del zones[rank]
            else:
                zones[rank] = (*ends, before, n)
    return found


def exact_quantiles(df: DataFrame, column: str, probs: list[float], small: int = SMALL_ZONE) -> list[float | None]:
    """The quantiles of a numeric column, interpolated between neighbouring ranks.

    Values count as doubles; nulls and NaN are left out.  No value left: None for
    each.  The column is written once, and every round reads only that table.
    """
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("quantiles lie between 0 and 1")
    value = F.col(column).cast("double")
    values = materialize(df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "quantile-values")
    total = values.count()
    if not total or not probs:
        return [None] * len(probs)
    at = [p * (total - 1) for p in probs]
    found = select_ranks(values, [r for h in at for r in (math.floor(h), math.ceil(h))], total, small)
    out = []
    for h in at:
        low, high = found[math.floor(h)], found[math.ceil(h)]
        out.append(low if low == high else low + (h - math.floor(h)) * (high - low))
    return out
