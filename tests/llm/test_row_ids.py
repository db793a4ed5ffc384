"""Row ids hold although a table is split in another way by each job, as when executors come and go."""

import uuid

import pytest

from knockon.llm import decontam, exact_dedup, mixing, queries, simhash, warc
from tests.llm.helpers import docs
from tests.oracle_compare import compare, duck

SPLITS = "spark.sql.files.minPartitionNum"
ROWS = [(i, f"text number {i % 60} of the corpus " + " ".join(f"w{i % 60}x{j}" for j in range(20)), "en", f"s{i % 3}")
        for i in range(240)]


@pytest.fixture
def split(spark):
    """Sets the number of splits of the next scans: all files in one, or each in its own."""
    yield lambda n: spark.conf.set(SPLITS, str(n))
    spark.conf.unset(SPLITS)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    docs(spark, ROWS).repartition(8, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_deduplication_keeps_one_row_of_each_text(table, split):
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        split(8)
        kept = drop(table)
        split(1)
        rows = kept.collect()
        assert len(rows) == 60 and sorted(r.doc_id for r in rows) == list(range(60))


def test_exact_groups_keep_one_row_of_each_text(table, split):
    split(8)
    groups = exact_dedup.exact_groups(table)
    split(1)
    assert sorted(r.id for r in groups.where("kept").collect()) == list(range(60))


def test_mix_draws_the_planned_rows(table, split):
    split(8)
    planned = mixing.plan(table, budget=2000)
    want = sorted(r.id for r in planned.where("copies > 0").collect())
    mixed = mixing.mix(table, budget=2000)
    split(1)
    got = mixed.collect()
    tokens = sum(r.mix_copies * len(r.text.split()) for r in got)
    assert 2000 - 3 * 30 <= tokens <= 2000 and len(got) == len(want)


def test_hits_of_later_blocks_go_to_their_rows(spark, table, split):
    bench = spark.createDataFrame([(i, ROWS[i][1]) for i in range(0, 60, 7)], "item_id long, text string")
    split(8)
    found = decontam.with_hits(table, bench, block=10)
    split(1)
    for r in found.collect():
        assert {h.item for h in r["__hits"]} == ({str(r.doc_id % 60)} if r.doc_id % 60 % 7 == 0 else set())


def test_replicas_share_one_layout(spark, split, monkeypatch):
    sf, made, leaves = "/root/testdata/sf0.01", [], warc.leaves

    def split_anew(records):
        made.append(split([1, 3][len(made) % 2]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["128m", "64k"][len(made) % 2])
        return leaves(records)
    monkeypatch.setattr(warc, "leaves", split_anew)
    try:
        ok, message = compare(spark, duck(sf), "op10_warc_fixity", queries.QUERIES["op10_warc_fixity"],
                              queries.ORACLES["op10_warc_fixity"], sf)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(made) == 2 and ok, message
