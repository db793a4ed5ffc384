"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of all tokens to a power, normalised.  The power
is found by repeated sectioning of an interval: the smallest one whose weights
have at most the target entropy and repeat no source more often than allowed.
Each pass evaluates a row of exponents in one aggregation over the source table.
The interval grows until it holds that power; a target or limit that no power
meets is an error.  With ``sharpen=False`` the target only says how far to
flatten: where the natural mix is above it already, the power stays at 1, with a
warning that names both entropies.

Realisation: a source's documents fall into ``BLOCKS`` blocks by hash.  Every
epoch takes the blocks in an order of its own.  Whole epochs give every document
a copy; the last, partial epoch takes blocks in its order while the source's
token budget lasts, and from the block at the edge documents in hash order.  So
a source misses its budget by less than its longest document.

All joins and running sums go by (source, block), so a hot source is spread.

Defined results: a null source is a source of its own; null or blank texts have
no tokens and share their source's whole epochs; a source without tokens gets
weight zero and no copies; an empty table gives an empty plan; repeated rows are
rows of their own; extra columns are kept by ``mix`` and not read by ``plan``.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knockon.llm.common import numbered, row_id, shared_table

BLOCKS = 1024
SECTIONS = 16
PRECISION = 1e-9
#: Rounding allowed for where an entropy, or a number of passes, meets its bound.
SLACK = 1e-12


def token_count(text: Column) -> Column:
    """Words parted by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sums_table(shares: DataFrame, exponents: list[float]) -> DataFrame:
    """One row (i, z, e, m) per exponent, as ``_sums`` gives them; the plan is the same for all exponents."""
    a, below = F.col("a"), F.col("below")
    power = F.exp(a * below)
    return (shares.select("log_share", "below", F.posexplode(F.lit(exponents).cast("array<double>")).alias("i", "a")).groupBy("i")
            .agg(F.sum(power).alias("z"), F.sum(power * below).alias("e"), F.max(F.exp(a * below - F.col("log_share"))).alias("m")))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent a: the sums of q^a and q^a ln q, and the largest q^a / p.

    q is a share p over the largest share, so no exponent makes all powers vanish.
    """
    return [(r["z"], r["e"], r["m"]) for r in sorted(_sums_table(shares, exponents).collect(), key=lambda r: r["i"])]


def _smallest(shares: DataFrame, top: float, fits) -> float:
    """The smallest exponent in [0, top] that fits; ``top`` if only that may."""
    low, high = 0.0, top
    if fits(0.0, *_sums(shares, [0.0])[0]):
        return 0.0
    while high - low > PRECISION * max(1.0, high):
        inner = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        found = [fits(a, *s) for a, s in zip(inner, _sums(shares, inner))]
        first = found.index(True) if True in found else len(inner)
        low, high = ([low] + inner)[first], (inner + [high])[first]
    return min(math.ceil(high * 1e9) / 1e9, top)


def _entropy(a: float, z: float, e: float) -> float:
    return math.log(z) - a * e / z


def find_exponent(shares: DataFrame, budget_ratio: float, entropy: float | None, repeats: float | None,
                  sharpen: bool = True) -> float:
    """Smallest exponent with at most ``entropy`` (nats) and ``repeats`` passes over any source.

    ``shares`` has one row per source with tokens: its ``log_share``, and
    ``below``, the same less the largest; ``budget_ratio`` is the budget over all
    tokens.  Entropy falls with the exponent, down to that of the sources that
    tie for the largest share.  Repetition falls up to exponent 1, where all
    sources repeat ``budget_ratio`` times, and rises beyond.  So the larger of the
    two smallest exponents meets both bounds if any does; else ``ValueError``.
    """
    exponent = 1.0 if entropy is None and repeats is None else 0.0
    if entropy is not None:
        def within(a, z, e, m):
            return _entropy(a, z, e) <= entropy + SLACK
        top, natural = 1.0, _sums(shares, [1.0])[0]
        if not within(1.0, *natural) and not sharpen:
            warnings.warn(f"entropy {_entropy(1.0, *natural[:2]):.6f} of the natural mix is above the target "
                          f"{entropy:.6f}: exponent 1 is kept", stacklevel=2)
            exponent = 1.0
        else:
            least = math.log(shares.where("below = 0").count())
            if least > entropy + SLACK:
                raise ValueError(f"no exponent has entropy {entropy:.6f}: the largest sources tie at {least:.6f}")
            while not within(top, *_sums(shares, [top])[0]):
                top *= 2
            exponent = _smallest(shares, top, within)
    if repeats is not None:
        exponent = max(exponent, _smallest(shares, 1.0, lambda a, z, e, m: budget_ratio * m / z <= repeats))
        z, _, m = _sums(shares, [exponent])[0]
        if budget_ratio * m / z > repeats * (1 + PRECISION):
            raise ValueError(f"no exponent meets both bounds: at {exponent:.9g} a source is repeated "
                             f"{budget_ratio * m / z:.6g} times, more than {repeats:g}")
    return exponent


def source_plan(counted: DataFrame, budget: int | None, entropy_share: float | None,
                repeats: float | None, sharpen: bool = True, flatten: float | None = None) -> DataFrame:
    """One row per source: tokens, weight, quota, epochs (whole passes), rest (tokens of the last pass)."""
    tokens = shared_table(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    total, largest, sources = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.max("tokens"),
                                         F.count(F.when(F.col("tokens") > 0, 1))).first()
    if not total:
        return tokens.withColumns({"weight": F.lit(0.0), "quota": F.lit(0.0), "epochs": F.lit(0).cast("long"),
                                   "rest": F.lit(0.0)})
    budget = total if budget is None else budget
    below = F.log(F.col("tokens") / float(largest))
    shares = tokens.where("tokens > 0").select(F.log(F.col("tokens") / float(total)).alias("log_share"),
                                               below.alias("below"))
    entropy = None if entropy_share is None else entropy_share * math.log(sources)
    if flatten is not None:  # between the natural entropy (0) and the largest (1): met by an exponent of 1 to 0
        natural = _entropy(1.0, *_sums(shares, [1.0])[0][:2])
        entropy = natural + flatten * (math.log(sources) - natural)
    exponent = find_exponent(shares, budget / total, entropy, repeats, sharpen)
    scale = _sums(shares, [exponent])[0][0]
    weight = F.when(F.col("tokens") > 0, F.exp(exponent * below) / scale).otherwise(0.0)
    quota = F.col("weight") * float(budget)
    whole = F.floor(F.col("quota") / F.col("tokens") + SLACK)  # a pass short of whole by rounding alone is whole
    return (tokens.withColumn("weight", weight).withColumn("quota", quota)
            .withColumn("epochs", F.when(F.col("tokens") > 0, whole).otherwise(0).cast("long"))
            .withColumn("rest", F.greatest(F.col("quota") - F.col("epochs") * F.col("tokens"), F.lit(0.0))))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         budget: int | None = None, entropy_share: float | None = None, repeats: float | None = None,
         seed: int = 0, sharpen: bool = True, row_col: str | None = None, flatten: float | None = None) -> DataFrame:
    """One row per input row: id, row, source, n_tokens, weight, passes, block, copies.

    ``budget`` is in tokens (default: all tokens), ``entropy_share`` the target
    as a share of the largest possible entropy; ``sharpen`` lets it ask for more
    than exponent 1.  ``flatten`` sets the target instead between the natural
    entropy (0) and the largest (1), so any mix is flattened by its own measure.
    ``row_col`` names the column of a written table that holds
    the row ids already.
    """
    row = row_id() if row_col is None else F.col(row_col)
    key = F.when(F.col("name").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("name")))
    counted = shared_table(
        docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(source_col).cast("string").alias("name"),
                    token_count(F.col(text_col)).alias("n_tokens"))
        .withColumn("source", key)
        .withColumn("block", F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.lit(BLOCKS)).cast("int")), "mix-rows")
    sources = shared_table(source_plan(counted, budget, entropy_share, repeats, sharpen, flatten), "mix-plan")
    turn = F.xxhash64("source", "epochs", "block", F.lit(seed))
    in_turn = Window.partitionBy("source").orderBy("turn", "block")
    blocks = (counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
              .join(sources.select("source", "tokens", "weight", "quota", "epochs", "rest"), "source")
              .withColumn("turn", turn).withColumn("upto", F.sum("size").over(in_turn))
              .withColumn("left", F.col("rest") - (F.col("upto") - F.col("size"))))
    blocks = shared_table(blocks.select("source", "block", "weight", "epochs", "left",
                                        F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(0.0).alias("passes"),
                                        (F.col("size") <= F.col("left")).alias("whole")), "mix-blocks")
    edge = blocks.where(~F.col("whole") & (F.col("left") > 0)).select("source", "block", "left")
    in_block = Window.partitionBy("source", "block").orderBy(F.xxhash64("id", "row", F.lit(seed + 1)), "row")
    at_edge = (counted.join(edge, ["source", "block"]).withColumn("upto", F.sum("n_tokens").over(in_block))
               .where(F.col("upto") <= F.col("left")).select("row", F.lit(1).alias("taken")))
    return (counted.join(blocks, ["source", "block"]).join(at_edge, "row", "left")
            .select("id", "row", F.col("name").alias("source"), "n_tokens", "weight", "passes", "block",
                    (F.col("epochs") + F.when(F.col("whole") & (F.col("weight") > 0), 1)
                     .otherwise(F.coalesce("taken", F.lit(0)))).cast("long").alias("copies")))


def schedule(planned: DataFrame, seed: int = 0) -> DataFrame:
    """One row per copy drawn: id, source, n_tokens, weight, epoch, block, position.

    Sorted by ``position`` (0 to 1) the copies form the mix: epochs of a source
    follow each other, each with its own order of blocks, spread over the mix.
    """
    source = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    drawn = planned.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    turn = F.xxhash64(source, "epoch", "block", F.lit(seed)) / float(1 << 64) + 0.5  # the order plan() takes blocks in
    return drawn.select("id", "row", "source", "n_tokens", "weight", "epoch", "block",
                        F.least((F.col("epoch") + turn) / F.greatest("passes", F.lit(1e-12)), F.lit(1.0)).alias("position"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The rows that are drawn, with all their columns, ``mix_weight`` and ``mix_copies``.

    Columns of these names in ``docs`` are replaced.
    """
    rows = numbered(docs.drop("mix_weight", "mix_copies"), "mix-docs")
    drawn = plan(rows, id_col, text_col, source_col, row_col="__row", **options).where("copies > 0").select(
        F.col("row").alias("__drawn"), F.col("weight").alias("__weight"), F.col("copies").alias("__copies"))
    return (rows.join(drawn, F.col("__row") == F.col("__drawn")).drop("__row", "__drawn")
            .withColumnsRenamed({"__weight": "mix_weight", "__copies": "mix_copies"}))
