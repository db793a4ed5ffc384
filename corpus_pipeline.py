"""Corpus preparation: the stages that turn ``documents`` into a training mix.

Each stage takes what the one before kept, as a table reread from Parquet, and
returns its rows with the columns of ``documents``; the last adds the weight and
number of copies of each row of the mix.  Nulls, empty and repeated rows are
handled as the operators document; no stage needs unique ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knockon.llm import decontam, exact_dedup, langid, mixing, simhash
from knockon.llm.common import shared_table
from knockon.llm.queries import MIX_FLATTEN, MIX_REPEATS, SHINGLE_WORDS, SIMHASH_DISTANCE


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; null texts and texts without letters go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs, prefer="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE_WORDS, distance=SIMHASH_DISTANCE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold too little of the benchmark to count as contaminated."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows drawn for the mix, with ``mix_weight`` and ``mix_copies``."""
    return mixing.mix(docs, flatten=MIX_FLATTEN, repeats=MIX_REPEATS)


STAGES = [
    ("language ID", identified),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

#: The trained language model and XXH64 fingerprints have no DuckDB form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs, f"stage{i}")
    return docs
