"""How far the sources of a language differ in their words: an audit over a single-pass inverted index.

Single-pass in-memory indexing: a task reads whole texts and builds block
postings, the occurrences of each term per (language, source) and the number of
documents per language.  When the block holds ``BLOCK_POSTINGS`` postings it is
spilled as a run sorted by (language, term).  Runs are dealt out to shards by
the hash of (language, term); within a shard Spark's external sort merges the
sorted runs by a priority queue, and one streaming pass folds equal terms into
frequencies.  A block sends one row per posting, so a word of every document
costs as many rows a block as there are sources.

Frequencies give add-two smoothed rates p in billionths, all in integers.  The
divergence of two rates is f = floor((p - q)^2 / (p + q)).  A pair of sources
sums f over every kept term of the language.  Nearly all terms are absent from
most sources, where the rate is the source's floor rate, so the sum starts as
V * f(floor, floor) and corrections are streamed:

* terms of one source against the other's floor, from the histogram of its
  counts (how many terms it holds so often), and
* terms that both hold, from their posting lists: neighbours 1, 2, 3, ... places
  apart in a list, a batch of terms at a time, summed per pair inside the tasks.

Each pair of sources of a language is a row of the result; nothing else is
expanded into pairs, and no task or driver holds all of them.

Defined results: null text, language and source count as ''.  A language
without kept terms has pair values 0; a source alone in its language has no
pairs.  Repeated rows count each; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knockon.llm.common import shared_table

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
SMOOTHING = 2
#: Postings (term and source) of a block in memory before it is spilled as a run.
BLOCK_POSTINGS = 500_000
#: Bytes of a text that are split into terms at once.
SLICE = 1 << 22
#: Rows of a run sent on at once.
RUN_ROWS = 20_000
#: Rows of one term folded at once, and pair sums held by a task before it sends them on.
FOLD_ROWS = 50_000
PAIR_SUMS = 1_000_000

#: Bytes of terms are letters and all bytes above ASCII; other bytes separate.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms (UTF-8) of the whole text, slice by slice."""
    data = (text or "").encode("utf-8", "replace").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + SLICE) if at + SLICE < len(data) else -1
        yield data[at:to if to >= 0 else len(data)].split()
        at = to if to >= 0 else len(data)


def _run(counts: dict, documents: dict) -> Iterator[pa.RecordBatch]:
    """The block as a run sorted by (language, term)."""
    for lang in sorted({lang for lang, _ in counts}):
        groups = [(source, own, documents[lang, source]) for (of, source), own in counts.items() if of == lang and own]
        if not groups:
            continue
        terms = pa.concat_arrays([pa.array(list(own), pa.binary()) for _, own, _ in groups])
        sources = pa.array([source for source, _, _ in groups]).take(
            pa.array(np.repeat(np.arange(len(groups)), [len(own) for _, own, _ in groups])))
        sums = pa.array(np.concatenate([np.fromiter(own.values(), np.int64, len(own)) for _, own, _ in groups]))
        held = pa.array(np.concatenate([np.fromiter(map(of.__getitem__, own), np.int64, len(own))
                                        for _, own, of in groups]))
        order = pc.sort_indices(terms)
        for at in range(0, len(order), RUN_ROWS):
            rows = order.slice(at, RUN_ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang), len(rows)), terms.take(rows).cast(pa.string()),
                 *(column.take(rows) for column in (sources, sums, held))], names=COLUMNS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block postings per task, spilled as sorted runs."""
    counts: dict[tuple[str, str], Counter] = {}
    documents: dict[tuple[str, str], Counter] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
            own = counts.setdefault((lang, source), Counter())
            before = len(own)
            seen: set[bytes] = set()
            for terms in terms_of(text):
                own.update(terms)
                seen.update(terms)
            documents.setdefault((lang, source), Counter()).update(seen)
            held += len(own) - before
            if held >= BLOCK_POSTINGS:
                yield from _run(counts, documents)
                counts, documents, held = {}, {}, 0
    yield from _run(counts, documents)


def _starts(rows: pa.Table) -> np.ndarray:
    """True where a (language, term) begins in sorted rows."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        differ = [pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1))
                  for column in (rows["term"].combine_chunks(), rows["lang"].combine_chunks())]
        out[1:] = pc.or_(*differ).to_numpy(zero_copy_only=False)
    return out


def _whole_terms(batches: Iterator[pa.RecordBatch], fold=None) -> Iterator[pa.Table]:
    """The sorted rows again, cut between terms; ``fold`` shortens the rows of a term that fills batches."""
    rest = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rest = new if rest is None else pa.concat_tables([rest, new])
        last = int(np.flatnonzero(_starts(rest))[-1]) if len(rest) else 0
        if last:
            yield rest.slice(0, last)
            rest = rest.slice(last)
        elif fold and len(rest) >= FOLD_ROWS:
            rest = fold(rest)
    if rest is not None and len(rest):
        yield rest


COLUMNS = ["lang", "term", "source", "count", "documents"]
POSTINGS = "lang string, term string, source string, count long, documents long"


def _folded(rows: pa.Table) -> pa.Table:
    sums = rows.group_by(COLUMNS[:3]).aggregate([("count", "sum"), ("documents", "sum")])
    return sums.select([*COLUMNS[:3], "count_sum", "documents_sum"]).rename_columns(COLUMNS)


def _merged(least: int):
    """Task function over the sorted rows of a shard: postings of the terms of enough documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_terms(batches, _folded):
            begins = np.flatnonzero(_starts(rows))
            held = np.add.reduceat(rows["documents"].to_numpy(), begins)
            enough = np.repeat(held >= least, np.diff(np.r_[begins, len(rows)]))
            if enough.any():
                yield from _folded(rows.filter(pa.array(enough))).to_batches()
    return run


def index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Postings lang, term, source, count of the kept terms (docs: lang, source, text; no null lang or source).

    The documents of a term are the sum over its postings.
    """
    runs = docs.select("lang", "source", "text").mapInArrow(_index, POSTINGS)
    shards = runs.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(_merged(least), POSTINGS)


def rate(count: Column, size: Column) -> Column:
    """Smoothed rate in billionths; ``size`` is the number of occurrences plus twice the number of terms."""
    scaled = (count + SMOOTHING).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, size.cast("decimal(19,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _pair_sums(table: pa.Table, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups, as code * 2^32 + code, and their corrections over the terms in ``table`` (whole terms)."""
    rows = table.select(["lang", "source", "p", "floor"]).to_pandas()
    group = np.array([codes.setdefault(g, len(codes)) for g in zip(rows["lang"], rows["source"])], np.int64)
    term = np.cumsum(_starts(table))
    p, floor = rows["p"].to_numpy(np.int64), rows["floor"].to_numpy(np.int64)
    at, apart, keys, sums = np.arange(len(rows)), 0, [], []
    while True:
        apart += 1
        at = at[at + apart < len(rows)]
        at = at[term[at] == term[at + apart]]
        if not len(at):
            break
        other = at + apart
        pa, pb, fa, fb = p[at], p[other], floor[at], floor[other]
        more = _f(pa, pb) - _f(pa, fb) - _f(fa, pb) + _f(fa, fb)
        low, high = np.minimum(group[at], group[other]), np.maximum(group[at], group[other])
        keys.append(low << 32 | high)
        sums.append(more)
        if sum(map(len, keys)) > PAIR_SUMS:
            key, total = _sum_by(np.concatenate(keys), np.concatenate(sums))
            keys, sums = [key], [total]
    return (_sum_by(np.concatenate(keys), np.concatenate(sums)) if keys
            else (np.zeros(0, np.int64), np.zeros(0, np.int64)))


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[begins], np.add.reduceat(values, begins) if len(begins) else values


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for terms that both sources of a pair hold, summed per task."""
    codes: dict[tuple[str, str], int] = {}
    keys = sums = np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        groups = list(codes)
        return pa.RecordBatch.from_pandas(pd.DataFrame({
            "lang": [groups[k >> 32][0] for k in keys.tolist()], "a": [groups[k >> 32][1] for k in keys.tolist()],
            "b": [groups[k & (1 << 32) - 1][1] for k in keys.tolist()], "value": sums}), preserve_index=False)
    for batch in _whole_terms(batches):
        key, total = _pair_sums(batch, codes)
        keys, sums = _sum_by(np.concatenate([keys, key]), np.concatenate([sums, total]))
        if len(keys) > PAIR_SUMS:
            yield rows()
            codes, keys, sums = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys):
        yield rows()


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Rows lang, source, part, item, value, rank: other sources (``pair``) and telling terms (``term``)."""
    def filled(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)
    rows = docs.select(filled(lang_col, "lang"), filled(source_col, "source"), filled(text_col, "text"))
    kept = shared_table(index(rows, least).drop("documents"), "divergence-postings")
    totals = kept.groupBy("lang", "term").agg(F.sum("count").alias("total"))
    size = F.col("n") + SMOOTHING * F.col("terms")
    floor = F.when(F.col("terms") > 0, rate(F.lit(0), size)).otherwise(F.lit(0))
    langs = shared_table(totals.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("n")),
                         "divergence-langs")
    groups = (rows.select("lang", "source").distinct()
              .join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
              .join(langs.select("lang", "terms"), "lang", "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      F.coalesce("terms", F.lit(0)).cast("long").alias("terms")))
    groups = shared_table(groups.withColumns({"size": size, "floor": floor.cast("long")}), "divergence-groups")

    overall = totals.join(langs.select("lang", size.alias("all")), "lang").select(
        "lang", "term", rate(F.col("total"), F.col("all")).alias("q"))
    rated = (kept.join(overall, ["lang", "term"])
             .join(groups.select("lang", "source", "size", "floor"), ["lang", "source"])
             .select("lang", "source", "term", "q", rate(F.col("count"), F.col("size")).alias("p"), "floor"))
    rated = shared_table(rated, "divergence-rates")

    order = [F.col("value").desc(), F.col("item").asc()]
    best = Window.partitionBy("lang", "source").orderBy(*order)
    terms = (rated.where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     divergence(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))

    others = groups.select("lang", F.col("source").alias("item"), F.col("floor").alias("floor_b"))
    bare = F.when(F.col("terms") > 0, divergence(F.col("floor"), F.col("floor_b"))).otherwise(F.lit(0).cast("long"))
    paired = groups.join(others, "lang").where("source <> item")
    start = paired.select("lang", "source", "item", (F.col("terms") * bare).alias("value"))
    histogram = rated.groupBy("lang", "source", "p", "floor").agg(F.count(F.lit(1)).alias("n"))
    lone = (histogram.join(others, "lang").where("source <> item")
            .groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (
                divergence(F.col("p"), F.col("floor_b")) - divergence(F.col("floor"), F.col("floor_b")))).alias("value")))
    lists = rated.select("lang", "term", "source", "p", "floor").repartition("lang", "term").sortWithinPartitions(
        "lang", "term")
    both = (lists.mapInArrow(_shared_terms, "lang string, a string, b string, value long")
            .select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"))
    turned = [part.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
              for part in (lone, both)]
    sums = start
    for part in (lone, both, *turned):
        sums = sums.unionByName(part)
    pairs = (sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(best)))
    return pairs.unionByName(terms)
