"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over the corpus.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z.
A window is ``size`` consecutive words of a benchmark item; a shorter, non-empty
item is one window.  Tasks look up rolling hashes of a document's word windows
in the set and verify every hit word by word, so hash collisions never count.

The set is broadcast in blocks of about ``BLOCK_WINDOWS`` windows, one at a time.
A benchmark of one block is one narrow pass over the text; for a larger one the
rows are written once with their ids, and no text is shuffled until the hits are
joined back.

Defined results: null text has no words; an empty benchmark leaves every
document clean; repeated items and rows change nothing; null item texts are
skipped and a null item id is reported as ``""``; extra columns are kept by
``with_hits`` and ``decontaminate``, and internal names start with ``__``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knockon.llm.common import numbered, shared_table

WINDOW = 13
#: Windows in one broadcast block (some 500 bytes each in a task).
BLOCK_WINDOWS = 100_000
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)

HITS = "n_words long, hits array<struct<item:string,start:long,length:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes from 128 up belong to words just like the characters they encode."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, words) for every window of every item, each once."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = (benchmark.where(F.col(text_col).isNotNull())
             .select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("w"))
             .where(F.size("w") > 0))
    return items.select("item", "w", F.explode(
        F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at")).select(
        "item", F.array_join(F.slice("w", F.col("at"), F.lit(size)), " ").alias("words")).distinct()


class WindowSet:
    """Hash set of one block of windows; built on the driver, used in tasks."""

    def __init__(self, rows: list[tuple[str, str]]):
        windows: dict[tuple, list[str]] = {}
        self.ids: dict[bytes, int] = {}
        for item, text in rows:
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in text.encode().split(b" "))
            windows.setdefault(key, []).append(item)
        self.items = {k: sorted(v) for k, v in windows.items()}
        self.codes = np.random.default_rng(7).integers(0, 1 << 63, len(self.ids) + 1).astype(np.uint64)
        self.hashes = {}
        for size in sorted({len(k) for k in windows}):
            keys = np.array([k for k in windows if len(k) == size])
            self.hashes[size] = np.unique(self._roll(keys.ravel(), np.arange(0, keys.size, size), size))

    def _roll(self, ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(len(starts), np.uint64)
        for j in range(size):
            total = total * _PRIME + self.codes[ids[starts + j]]
        return total

    def find(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(item, first word, words) of each verified occurrence."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        found = []
        for size, hashes in self.hashes.items():
            if len(words) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            rolled = self._roll(ids, starts, size)
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for start in starts[hashes[at] == rolled].tolist():
                for item in self.items.get(tuple(ids[start:start + size].tolist()), ()):
                    found.append((item, start, size))
        return found


def _scan(text: Column, window_set) -> Column:
    """struct(n_words, hits) by the windows of a broadcast set."""
    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        look = window_set.value
        for texts in batches:
            n, hits = [], []
            for text in texts:
                words = words_of(text)
                n.append(len(words))
                hits.append(look.find(words))
            yield pd.DataFrame({"n_words": n, "hits": pd.Series(hits, dtype=object)})
    return run(text)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text", size: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``__n_words`` and ``__hits`` (item, first word, words of each occurrence).

    A set of up to ``block`` windows is one pass that adds columns.  A larger one
    is a pass for each block over the rows written once with their ids, with one
    block in memory at a time; rows with hits are written, and joined back by id.
    """
    context = docs.sparkSession.sparkContext
    windows = benchmark_windows(benchmark, item_id, item_text, size).withColumn("h", F.xxhash64("item", "words"))
    windows = shared_table(windows, "benchmark-windows")
    blocks = max(1, -(-windows.count() // block))

    def window_set(i: int):
        rows = windows.where(F.pmod("h", F.lit(blocks)) == i).select("item", "words").collect()  # about ``block`` rows
        return context.broadcast(WindowSet([(r["item"], r["words"]) for r in rows]))

    text = F.col(text_col)
    if blocks > 1:
        docs = numbered(docs, "benchmark-docs")
    out = docs.withColumn("__scan", _scan(text, window_set(0)))
    if blocks == 1:
        return out.withColumns({"__n_words": F.col("__scan.n_words"), "__hits": F.col("__scan.hits")}).drop("__scan")
    parts = None
    for i in range(1, blocks):
        sent = window_set(i)
        found = docs.select(F.col("__row").alias("row"), _scan(text, sent).getField("hits").alias("hits"))
        found = shared_table(found.where(F.size("hits") > 0), "benchmark-hits")
        sent.unpersist()
        parts = found if parts is None else parts.union(found)
    more = parts.groupBy(F.col("row").alias("__hit_row")).agg(F.flatten(F.collect_list("hits")).alias("__more"))  # a list from each block at most
    return (out.join(more, F.col("__row") == F.col("__hit_row"), "left")
            .withColumns({"__n_words": F.col("__scan.n_words"),
                          "__hits": F.concat("__scan.hits", F.coalesce("__more", F.array().cast(
                              "array<struct<item:string,start:long,length:int>>")))})
            .drop("__scan", "__row", "__hit_row", "__more"))


def hit_words(hits: Column) -> Column:
    """Number of words inside any occurrence: the occurrences merged in order of their start."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(
        h.start.alias("a"), (h.start + h.length).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        (acc.n + F.greatest(s.b - F.greatest(acc.end, s.a), F.lit(0).cast("long"))).alias("n"),
        F.greatest(acc.end, s.b).alias("end")), lambda acc: acc.n)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (HIT_SHARE * n_hit >= n_words)


def strip_hits(text: Column, hits: Column) -> Column:
    """The text without the characters from the first to the last word of each occurrence."""
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([cut_words(t, [(h["start"], h["start"] + h["length"]) for h in hs])
                             if t is not None and hs is not None and len(hs) else t
                             for t, hs in zip(texts, found)], dtype=object)
    return run(text, hits)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """Remove word ranges (end exclusive); what lies between the words of a range goes too."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept, end = [], 0
    for a, b in sorted(spans):
        kept.append(text[end:max(end, at[a][0])])
        end = max(end, at[b - 1][1])
    return "".join(kept) + text[end:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  mode: str = "documents", **options) -> DataFrame:
    """Remove contaminated documents (``mode="documents"``), or only the hit spans (``"spans"``)."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be 'documents' or 'spans'")
    found = with_hits(docs, benchmark, text_col, **options)
    if mode == "documents":
        return found.where(~is_contaminated(hit_words(F.col("__hits")), F.col("__n_words"))).drop("__n_words", "__hits")
    return found.withColumn(text_col, strip_hits(F.col(text_col), F.col("__hits"))).drop("__n_words", "__hits")
