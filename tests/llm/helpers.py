"""Small edge-case tables for the operator tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like results and helpers of the operators.
CLASHING = ("keep_id", "kept", "row", "id", "fp", "component", "score", "spans", "copies", "weight", "h",
            "_text", "_hash", "n_words", "token", "rule", "label", "text_sha256", "block", "position")

LONG = "lorem ipsum dolor " * 40_000


def docs(spark, rows, clash=False):
    """A documents table from (doc_id, text[, lang[, source]]) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(None).cast("string") for c in CLASHING})
    return df


EDGE_ROWS = [(1, "Same Text here"), (2, "same text HERE"), (2, "same text HERE"), (None, "same text here"),
             (3, None), (4, ""), (5, "é É"), (6, "É é"), (7, LONG), (8, LONG.upper()), (9, "  \t\n "),
             (None, None)]
