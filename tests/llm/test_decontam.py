import random
import re

import pytest
from pyspark.sql import functions as F

from knockon.llm import decontam
from tests.llm.helpers import EDGE_ROWS, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=13):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        if not w:
            continue
        n = min(size, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(own) - n + 1):
            if tuple(own[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)


def cases(seed):
    draw = random.Random(seed)
    vocabulary = ["ab", "cd", "EF", "gé", "1", "x9"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 3, 13, 14, 30])))) for i in range(30)]
    items += [(None, "ab cd ab cd"), (77, None), (78, "..."), (0, items[0][1]), (5, items[5][1])]
    rows = list(EDGE_ROWS)
    for i in range(60):
        text = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 50)))
        text += ". " + (draw.choice(items)[1] or "").replace(" ", draw.choice([" ", "--", ", "]))
        rows.append((100 + i, text))
    return items, rows


@pytest.mark.parametrize("block", [100_000, 20])
def test_matches_brute_force(spark, block):
    items, rows = cases(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.benchmark_windows(bench, "item_id", "text", 13).count() > 60  # several blocks of 20
    found = decontam.with_hits(docs(spark, rows, clash=True), bench, block=block)
    got = found.select("doc_id", F.length("text").alias("n"), "__n_words",
                       decontam.hit_words(F.col("__hits")).alias("n_hit"),
                       F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["item"]))).alias("items")).collect()
    want = sorted(((i, *brute(t, items)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r["__n_words"], r.n_hit, list(r["items"])) for r in got), key=repr) == want
    assert any(n for _, _, n, _ in want)


def test_documents_and_spans_are_removed(spark):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"Before, {item}! after"), (2, "clean words only"), (3, None), (4, ""),
            (5, f"{'pad ' * 400}{item}")]
    kept = decontam.decontaminate(docs(spark, rows, clash=True), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert kept.columns == docs(spark, [], clash=True).columns
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs(spark, rows), bench, mode="spans").collect()}
    assert cut[1] == "Before, ! after" and cut[2] == "clean words only" and cut[3] is None
    assert cut[5].strip("pad ") == ""


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs(spark, EDGE_ROWS), bench).count() == len(EDGE_ROWS)
    full = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert decontam.decontaminate(docs(spark, []), full).count() == 0
