import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from knockon.llm import exact_dedup
from tests.llm.helpers import EDGE_ROWS, docs


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, prefer):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = (max if prefer == "max" else min)(ids) if ids else None
        out.append((i, keep, len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def groups_of(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_edge_rows_match_brute_force(spark):
    for prefer in ("min", "max"):
        got = exact_dedup.exact_groups(docs(spark, EDGE_ROWS, clash=True), prefer=prefer)
        assert groups_of(got) == brute(EDGE_ROWS, prefer)
        kept = got.where("kept").collect()
        assert len(kept) == len({low(t) for _, t in EDGE_ROWS})
        assert all(r.id == r.keep_id for r in kept)


def test_collisions_are_told_apart_by_bytes(spark):
    table = docs(spark, EDGE_ROWS)
    got = exact_dedup.exact_groups(table, prefer="max", hasher=lambda t: F.length(t) % 3)
    assert groups_of(got) == brute(EDGE_ROWS, "max")
    assert got.where("kept").count() == len({low(t) for _, t in EDGE_ROWS})


def test_survivors_keep_their_columns(spark):
    table = docs(spark, EDGE_ROWS, clash=True)
    left = exact_dedup.drop_exact_duplicates(table, prefer="max")
    assert left.columns == table.columns
    assert left.count() == len({low(t) for _, t in EDGE_ROWS})


def test_empty_table(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs(spark, [])).count() == 0


def test_hot_text_and_unique_texts(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    assert groups_of(exact_dedup.exact_groups(docs(spark, rows))) == brute(rows, "min")
