"""Vector codes (product quantisation) with LAESA pivots.

A vector of integers floor(1024 * x) is cut into four parts; each part position
has a codebook of at most 256 entries.  Codebooks start from the vectors of the
smallest ids and go through rounds of assignment and componentwise floor means.

LAESA: a few pivots per part position are fixed at the start (entries of the
first codebook, each the farthest from those before).  Every part's distances to
its pivots are computed once and stored beside the vector.  In each round only
the entries' distances to the pivots are new: |d(part, pivot) - d(entry, pivot)|
bounds the distance of part and entry from below, so the entries of a part are
visited in the order of their largest bound, and the visit ends at the first
bound above the best distance so far.  Bounds are floats with a margin for their
rounding; distances are exact integers, ties go to the lower index.

A round is one narrow pass: a task adds up its parts per entry, Spark adds up
the tasks, and the driver takes the sums of at most 4 x 256 entries.

Defined results: null vectors and vectors with a null or non-finite component
are dropped.  The first kept vector (smallest id, nulls last, then smallest
vector) sets the length; vectors of another length take no part in the
codebooks and keep their row with a null code and error.  Lengths that four
does not divide are filled up with zeros.  Components of any size are exact; an
error beyond a long is null, also as a sum.  Repeated rows count each; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knockon.llm.common import shared_table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
PIVOTS = 8
#: Margin of a bound, as a share of the two distances it is made of (they are stored as 32-bit floats).
MARGIN = 1e-6
#: Sums travel as digits of this many bits, each a long.
DIGIT = 40
LONG = 1 << 63


def _integers(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled components as int64, and which rows are out of that path's safe range (their values are clipped)."""
    bound = _safe(width // PARTS)
    grid = np.zeros((len(vectors), width))
    if len(vectors) and len(vectors.iloc[0]):
        flat = np.stack(vectors.to_list()).astype(np.float64)
        grid[:, :flat.shape[1]] = np.floor(flat * SCALE)
    big = (np.abs(grid) > bound).any(axis=1) if width else np.zeros(len(grid), bool)
    return np.clip(grid, -bound, bound).astype(np.int64), big


def _exact(vector, width: int) -> list[int]:
    """Scaled components of one vector as integers of any size."""
    out = [math.floor(float(x) * SCALE) for x in vector]
    return out + [0] * (width - len(out))


def _safe(size: int) -> int:
    """Largest component for which squared distances of two parts stay below 2^62."""
    return int(math.isqrt((1 << 60) // max(size, 1)))


def _squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) * (x - y) for x, y in zip(a, b))


def _root(x: int) -> float:
    return math.sqrt(x) if x < 1 << 1000 else math.inf


class Codebook:
    """Entries of one part position, with their distances to that position's pivots."""

    def __init__(self, entries: list[list[int]], pivots: list[list[int]]):
        self.entries, self.pivots = entries, pivots
        size = len(entries[0])
        bound = _safe(size)
        self.hard = np.array([any(abs(x) > bound for x in e) for e in entries])
        self.values = np.array([[min(max(x, -bound), bound) for x in e] for e in entries],
                               np.int64).reshape(len(entries), size)
        self.reach = np.array([[_root(_squared(e, p)) for p in pivots] for e in entries])

    def bounds(self, reach: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of rows (with distances ``reach`` to the pivots) and entries."""
        least = np.zeros((len(reach), len(self.entries)))
        for p in range(len(self.pivots)):
            ours, theirs = reach[:, p:p + 1], self.reach[:, p]
            gap = np.abs(ours - theirs)
            gap -= MARGIN * (ours + theirs)
            np.fmax(least, gap, out=least, where=np.isfinite(gap))
        return least

    def nearest(self, parts: np.ndarray, reach: np.ndarray, big: np.ndarray, exact) -> tuple[np.ndarray, list[int]]:
        """Index of the nearest entry and squared distance of each row; ``exact(i)`` is row i unclipped."""
        least = self.bounds(reach)
        order = np.argsort(least, axis=1)
        least = np.take_along_axis(least, order, axis=1)
        best = np.full(len(parts), LONG - 1, np.int64)
        code = np.zeros(len(parts), np.int64)
        hard = big.copy()
        active = np.flatnonzero(~hard)
        for step in range(len(self.entries)):
            top = np.sqrt(best[active].astype(np.float64)) * (1 + MARGIN)
            active = active[least[active, step] <= top]
            if not len(active):
                break
            entry = order[active, step]
            beyond = self.hard[entry]
            if beyond.any():
                hard[active[beyond]] = True
                active, entry = active[~beyond], entry[~beyond]
            gap = parts[active] - self.values[entry]
            far = np.einsum("ij,ij->i", gap, gap)
            better = (far < best[active]) | (far == best[active]) & (entry < code[active])
            best[active[better]], code[active[better]] = far[better], entry[better]
        error = best.tolist()
        for i in np.flatnonzero(hard):
            code[i], error[i] = self._nearest_exact(exact(i), order[i], least[i])
        return code, error

    def _nearest_exact(self, part: list[int], order: np.ndarray, least: np.ndarray) -> tuple[int, int]:
        at, best = 0, None
        for entry, bound in zip(order.tolist(), least.tolist()):
            if best is not None and bound > _root(best) * (1 + MARGIN):
                break
            far = _squared(part, self.entries[entry])
            if best is None or (far, entry) < (best, at):
                at, best = entry, far
        return at, best


def choose_pivots(entries: list[list[int]], count: int = PIVOTS) -> list[list[int]]:
    """The first entry, then each time the entry farthest from those chosen."""
    chosen = [entries[0]]
    far = [_squared(e, entries[0]) for e in entries]
    while len(chosen) < min(count, len(entries)) and max(far) > 0:
        chosen.append(entries[far.index(max(far))])
        far = [min(f, _squared(e, chosen[-1])) for f, e in zip(far, entries)]
    return chosen


def _reach_column(pivots: list[list[list[int]]], width: int):
    """Distances of each part to its pivots, part after part."""
    size = width // PARTS

    @F.pandas_udf("array<float>")
    def run(vectors: pd.Series) -> pd.Series:
        ints, big = _integers(vectors, width)
        out = []
        for p, own in enumerate(pivots):
            part = ints[:, p * size:(p + 1) * size].astype(np.float64)
            for pivot in own:
                gap = part - np.array([float(x) if abs(x) < 1 << 1000 else math.inf for x in pivot]).reshape(1, size)
                with np.errstate(all="ignore"):
                    out.append(np.sqrt((gap * gap).sum(axis=1)))
        reach = np.stack(out, axis=1)
        for i in np.flatnonzero(big):
            row = _exact(vectors.iloc[i], width)
            reach[i] = [_root(_squared(row[p * size:(p + 1) * size], pivot))
                        for p, own in enumerate(pivots) for pivot in own]
        with np.errstate(over="ignore"):
            return pd.Series(list(reach.astype(np.float32)))
    return run


def _assign(vectors: pd.Series, reaches: pd.Series, books: list[Codebook], width: int):
    """Per part: integers of the rows, their entry, their squared distance, rows outside the int64 path."""
    size = width // PARTS
    ints, big = _integers(vectors, width)
    reach = np.stack(reaches.to_list()).astype(np.float64)
    at = 0
    for p, book in enumerate(books):
        part = ints[:, p * size:(p + 1) * size]
        near = reach[:, at:at + len(book.pivots)]
        at += len(book.pivots)
        code, error = book.nearest(part, near, big,
                                   lambda i, p=p: _exact(vectors.iloc[i], width)[p * size:(p + 1) * size])
        yield part, code, error, big


def _sums(books: list[Codebook], width: int):
    """Task function: sums of the components per entry, as digits, and counts (position -1)."""
    size = width // PARTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [[[0] * size for _ in b.entries] for b in books]
        counts = [[0] * len(b.entries) for b in books]
        for batch in batches:
            for p, (part, code, _, big) in enumerate(_assign(batch["vector"], batch["reach"], books, width)):
                fine = np.flatnonzero(~big)
                rows = fine[np.argsort(code[fine], kind="stable")]
                if len(rows):
                    starts = np.flatnonzero(np.r_[True, np.diff(code[rows]) > 0])
                    totals = np.add.reduceat(part[rows], starts, axis=0) if size else [[]] * len(starts)
                    for entry, total, n in zip(code[rows][starts].tolist(), np.asarray(totals).tolist(),
                                               np.diff(np.r_[starts, len(rows)]).tolist()):
                        sums[p][entry] = [a + b for a, b in zip(sums[p][entry], total)]
                        counts[p][entry] += n
                for i in np.flatnonzero(big):
                    own = _exact(batch["vector"].iloc[i], width)[p * size:(p + 1) * size]
                    sums[p][code[i]] = [a + b for a, b in zip(sums[p][code[i]], own)]
                    counts[p][code[i]] += 1
        rows = []
        for p in range(len(books)):
            for entry, n in enumerate(counts[p]):
                if n:
                    rows.append((p, entry, -1, 0, n))
                    for pos, total in enumerate(sums[p][entry]):
                        sign, rest, digit = (-1 if total < 0 else 1), abs(total), 0
                        while rest:
                            rows.append((p, entry, pos, digit, sign * (rest & (1 << DIGIT) - 1)))
                            rest >>= DIGIT
                            digit += 1
        yield pd.DataFrame(rows, columns=["part", "entry", "pos", "digit", "total"])
    return run


def _next_entries(table: DataFrame, books: list[Codebook], width: int) -> list[list[list[int]]]:
    """Entries after one round; entries that no part chose stay."""
    found = (table.select("vector", "reach").mapInPandas(
        _sums(books, width), "part int, entry int, pos int, digit int, total long")
        .groupBy("part", "entry", "pos", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    sums, counts = {}, {}
    for r in found.collect():  # at most parts x entries x (size + 1) cells, a few digits each
        if r.pos < 0:
            counts[r.part, r.entry] = int(r.total)
        else:
            key = (r.part, r.entry, r.pos)
            sums[key] = sums.get(key, 0) + (int(r.total) << DIGIT * r.digit)
    return [[[sums.get((p, e, i), 0) // counts[p, e] for i in range(width // PARTS)] if (p, e) in counts else old
             for e, old in enumerate(book.entries)] for p, book in enumerate(books)]


def codebooks_sha256(books: list[Codebook]) -> str:
    cells = [str(x) for book in books for entry in book.entries for x in entry]
    return hashlib.sha256(",".join(cells).encode()).hexdigest()


def _codes(books: list[Codebook], width: int):
    @F.pandas_udf("struct<code string, error long>")
    def run(vectors: pd.Series, reaches: pd.Series) -> pd.DataFrame:
        code, error = [""] * len(vectors), [0] * len(vectors)
        for _, own, far, _ in _assign(vectors, reaches, books, width):
            code = [a + f"{b:02x}" for a, b in zip(code, own.tolist())]
            error = [a + b for a, b in zip(error, far)]
        return pd.DataFrame({"code": code, "error": pd.array([x if x < LONG else None for x in error], "Int64")})
    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: id, label, code, error, label_error, codebooks_sha256."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull() & sound)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector")
    head = first.limit(1).collect()
    if not head:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    length = len(head[0].vector)
    width = -(-length // PARTS) * PARTS
    size = width // PARTS
    whole = kept.where(F.size("vector") == length)
    start = [_exact(r.vector, width) for r in
             whole.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()]
    entries = [[row[p * size:(p + 1) * size] for row in start] for p in range(PARTS)]
    pivots = [choose_pivots(own) for own in entries]
    table = shared_table(whole.withColumn("reach", _reach_column(pivots, width)("vector")), "vector-pivots")
    for _ in range(rounds):
        books = [Codebook(e, p) for e, p in zip(entries, pivots)]
        entries = _next_entries(table, books, width)
    books = [Codebook(e, p) for e, p in zip(entries, pivots)]
    coded = table.withColumn("found", _codes(books, width)("vector", "reach")).select(
        "id", "label", "found.code", "found.error")
    odd = kept.where(F.size("vector") != length).select(
        "id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = shared_table(coded.unionByName(odd), "vector-codes")
    labels = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    labels = labels.select(F.col("label").alias("of"), F.col("total").try_cast("long").alias("label_error"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
