"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knockon.session import materialize


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar: later readers prune
    columns and AQE sees real sizes.  A lost executor rereads files.
    """
    return materialize(df, name)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    On pure ASCII ``lower`` does just that and is much faster than ``translate``.
    """
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def is_held_out(id_col: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 2 modulo 4.

    A null id is hashed as empty text (crc32 0), so it is not held out.
    """
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def row_id() -> Column:
    """Identity of an input row, also where ids are null or repeated.

    Holds for one job only: a later scan of the same table may be split in another
    way, for it goes by the cores there are then.  So it is always written.
    """
    return F.monotonically_increasing_id()


def numbered(df: DataFrame, name: str, column: str = "__row") -> DataFrame:
    """``df`` written once with its ``row_id``: decisions and rows read from it agree on the ids."""
    return shared_table(df.withColumn(column, row_id()), name)
