"""Exact deduplication by 128-bit content hash, with byte comparison inside groups.

Native DataFrame code.  The input is written once with its row ids.  Texts are
grouped on (hash, text): the hash partitions and finds the group, the text
comparison inside the aggregate keeps colliding texts apart.  Partial aggregation
folds copies before the shuffle, so a text that makes up a third of all rows
crosses the network once per task.

Defined results: null text counts as empty text; equal (id, text) rows are one
group and exactly one of them is kept; a null id sorts below every id; an empty
table gives an empty result; extra columns are never read by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knockon.llm.common import ascii_lower, numbered, shared_table


def content_hash(text: Column) -> Column:
    """128-bit hash of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _keep(prefer: str):
    """Aggregate that picks the surviving row, by id and then by position."""
    if prefer not in ("min", "max"):
        raise ValueError("prefer must be 'min' or 'max'")
    if prefer == "min":
        order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_row"))
        return F.min(order)
    return F.max(F.struct(F.col("_id").isNotNull().alias("some"), F.col("_id"),
                          (-F.col("_row")).alias("_row")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 normalise=ascii_lower, prefer: str = "min", hasher=content_hash,
                 row_col: str | None = None) -> DataFrame:
    """One row per input row: id, row, keep_id, group_size, kept, text_sha256.

    ``prefer`` names the id that stays in a group.  ``row`` identifies the input
    row (see ``common.row_id``); ``row_col`` names the column of a written table that
    holds it already.  ``hasher`` can be replaced to test collisions.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       *([] if row_col is None else [F.col(row_col).alias("_row")]))
    rows = numbered(rows, "exact-rows", "_row") if row_col is None else rows
    keyed = rows.withColumn("_text", normalise(F.col("_text"))).withColumn("_hash", hasher(F.col("_text")))
    classes = keyed.groupBy("_hash", "_text").agg(
        _keep(prefer).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = shared_table(
        classes.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts"),
                                     F.first("_keep").alias("_keep"),
                                     F.sum("_size").alias("_size")), "exact-groups")
    rows = keyed.withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256))
    collided = groups.where("_texts > 1").select("_hash")
    if collided.isEmpty():
        members = rows.drop("_text").join(groups.drop("_texts"), "_hash")
    else:
        plain = rows.drop("_text").join(groups.where("_texts = 1").drop("_texts"), "_hash")
        mixed = rows.join(collided, "_hash", "left_semi").join(
            classes.join(collided, "_hash", "left_semi"), ["_hash", "_text"]).drop("_text")
        members = plain.unionByName(mixed)
    keep_row = F.abs(F.col("_keep._row"))
    return members.select(
        F.col("_id").alias("id"), F.col("_row").alias("row"),
        F.col("_keep._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (keep_row == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          prefer: str = "min") -> DataFrame:
    """The surviving rows with all their columns.

    The rows are matched back on their position, which is unique, so no key is hot.
    """
    rows = numbered(docs, "exact-docs")
    survivors = exact_groups(rows, id_col, text_col, prefer=prefer, row_col="__row").where("kept").select(
        F.col("row").alias("__kept_row"))
    return rows.join(survivors, F.col("__row") == F.col("__kept_row"), "left_semi").drop("__row")
