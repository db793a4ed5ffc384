"""SimHash near-duplicate groups with Pigeonring candidate filtering.

Fingerprints are computed per text in Arrow batches.  Linking runs on distinct
fingerprints only, so copies cost nothing.  A fingerprint is cut into
m = 2d + 1 segments on a ring.  If two fingerprints differ in at most d bits,
some chain of consecutive segments keeps every prefix of l segments within
floor(l * d / m) differing bits.  The first two segments of such a chain are
equal, which gives the join key (chain start, those two segments); the longer
prefixes prune candidates before the full bit count, which is the last prefix.

A key shared by many distinct fingerprints is not expanded into pairs.  Its
members go to the fingerprints within one bit of them (65 rows each): two
fingerprints differ in at most two bits exactly if they share such a centre,
and a centre has at most 65 members.

Defined results: null text counts as empty text, which has fingerprint zero and
is linked like any other; ids may be null or repeated; an empty table gives an
empty result; extra columns are never read by ``near_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knockon.llm.common import numbered, row_id, shared_table
from knockon.llm.components import connected_components

BITS = 64
SEED = 42
#: Hashes whose bits are counted at once.
COUNT_CHUNK = 1 << 15
#: Distinct fingerprints that a key may hold to be checked pair by pair.
PAIR_BUCKET = 32


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = list(map(len, words))
    starts = list(accumulate(lengths, lambda at, n: at + n + 1, initial=0))
    count = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ends = starts[shingle:]  # one past the blank after each shingle
    sums = np.zeros(BITS, np.int64)
    for at in range(0, count, COUNT_CHUNK):
        to = min(at + COUNT_CHUNK, count)
        hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts[at:to], ends[at:to])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * sums > count, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long (same 64 bits)."""
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return run(text)


def _ring(distance: int) -> list[int]:
    """Bit masks (signed) of the 2d + 1 segments."""
    m = 2 * distance + 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [_signed(((1 << b) - 1) & ~((1 << a) - 1)) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 & 1 else x


def _chain_fits(diff: Column, start: int, ring: list[int], distance: int) -> Column:
    """Every prefix of the chain from ``start`` stays within its share of the distance."""
    m, fits, mask = len(ring), F.lit(True), 0
    for length in range(1, m + 1):
        mask |= ring[(start + length - 1) % m]
        fits = fits & (F.bit_count(diff.bitwiseAND(F.lit(_signed(mask & (1 << 64) - 1)))) <= length * distance // m)
    return fits


def near_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` at most ``distance`` bits apart.

    Every such pair is joined by an edge or by a path of edges, and each edge is
    itself within the distance.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    ring = _ring(distance)
    m = len(ring)
    keys = [F.struct(F.lit(i).alias("start"),
                     F.col("fp").bitwiseAND(F.lit(ring[i] | ring[(i + 1) % m])).alias("key")) for i in range(m)]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.key")
    sizes = shared_table(keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                         "simhash-keys")

    few = (keyed.join(sizes.where(F.col("n") <= PAIR_BUCKET), ["start", "key"])
           .groupBy("start", "key").agg(F.collect_list("fp").alias("fps")))

    def fits(a: Column, b: Column) -> Column:
        diff = a.bitwiseXOR(b)
        check = F.lit(False)
        for i in range(m):
            check = F.when(F.col("start") == i, _chain_fits(diff, i, ring, distance)).otherwise(check)
        return check

    pairs = (few.select("start", "fps", F.explode("fps").alias("a"))
             .select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & fits(F.col("a"), b))).alias("b")))

    crowded = (keyed.join(sizes.where(F.col("n") > PAIR_BUCKET).select("start", "key"), ["start", "key"])
               .select("fp").distinct())
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << j)) for j in range(BITS)])
    centres = (crowded.select("fp", F.explode(flips).alias("flip"))
               .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
               .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    if distance == 1:  # members are one bit from the centre, two from each other
        centres = centres.where(F.array_contains("fps", F.col("centre"))).withColumn("hub", F.col("centre"))
    else:
        centres = centres.withColumn("hub", F.array_min("fps"))
    stars = centres.select(F.col("hub").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, distance: int = 2, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, row, fingerprint (hex), component_id, component.

    ``component`` identifies the group even where ids are null or repeated;
    ``component_id`` is its smallest id.  ``row_col`` names the column of a written
    table that holds the row ids already.
    """
    row = row_id() if row_col is None else F.col(row_col)
    rows = shared_table(docs.select(F.col(id_col).alias("id"), row.alias("row"),
                                    fingerprint_column(F.col(text_col), shingle).alias("fp")), "simhash-rows")
    prints = shared_table(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-prints")
    linked = connected_components(near_links(prints.select("fp"), distance), "a", "b")
    labelled = prints.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component"))
    names = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = shared_table(labelled.select("fp", "component").join(names, "component"), "simhash-classes")
    return rows.join(classes, "fp").select(
        "id", "row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id, then position."""
    rows = numbered(docs, "simhash-docs")
    groups = near_groups(rows, id_col, text_col, shingle, distance, "__row")
    survivors = groups.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("keep")).select(
        F.col("keep.row").alias("__kept_row"))
    return rows.join(survivors, F.col("__row") == F.col("__kept_row"), "left_semi").drop("__row")
