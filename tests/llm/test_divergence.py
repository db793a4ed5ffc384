"""The source audit against dense counting in Python."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from knockon.llm import divergence
from tests.llm.helpers import EDGE_ROWS, docs


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=10, top=10):
    rows = [(*r, *("en", "s")[len(r) - 2:]) for r in rows]  # as docs() fills up short rows
    rows = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(r[1]))) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, w) for lang_, s, w in rows if lang_ == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = [t for t in df if df[t] >= least]
        count = defaultdict(Counter)
        for s, w in own:
            count[s].update(t for t in w if df[t] >= least)
        total = sum(count.values(), Counter())
        size = len(kept)

        def rate(c, n):
            return 1 + 10**9 * (c + 2) // (n + 2 * size)

        def f(p, q):
            return (p - q) ** 2 // (p + q)
        p = {s: {t: rate(count[s][t], sum(count[s].values())) for t in kept} for s in count}
        q = {t: rate(total[t], sum(total.values())) for t in kept}
        for s in count:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i + 1) for i, (v, o) in enumerate(found[:most])]
    return sorted(out)


def check(spark, rows, **options):
    got = divergence.audit(docs(spark, rows, clash=True), **options).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, **options)


def corpus(draw, n):
    words = "Alpha beta gämma ß x'y 12 naïve ZÉRO delta kappa common-word e3f".split()
    return [(i, " ".join(draw.choices(words, weights=[draw.random() ** 3 for _ in words], k=draw.randint(0, 30))),
             draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "é", None])) for i in range(n)]


def test_matches_dense_counting(spark):
    check(spark, corpus(random.Random(1), 300))
    check(spark, corpus(random.Random(2), 60), least=3, top=2)


def test_small_blocks_and_sums_change_nothing(spark, monkeypatch):
    import pandas as pd
    rows = corpus(random.Random(3), 120)

    def merged():
        table = docs(spark, rows).fillna("").select("lang", "source", "text").toPandas()
        frames = [b.to_pandas() for b in divergence._index(iter([pa.RecordBatch.from_pandas(table)]))]
        total = {}
        for r in pd.concat(frames).itertuples():
            own = total.setdefault((r.lang, r.term), [0, Counter()])
            own[0] += r.documents
            own[1][r.source] += r.count
        return len(frames), total
    few, found = merged()
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 7)
    monkeypatch.setattr(divergence, "RUN_ROWS", 3)
    many, split = merged()
    assert many > few and split == found

    lists = [[0, 1, 2, 3, 4, 5, 6], [2, 9], [1, 5, 8], [3]]
    rows = pd.DataFrame([("en", f"t{t}", f"s{i}", 50 + 7 * i, 3 + i) for t, some in enumerate(lists) for i in some],
                        columns=["lang", "term", "source", "p", "floor"])

    whole_rows = pa.RecordBatch.from_pandas(rows)

    def pair_sums(size):
        total = Counter()
        for frame in divergence._shared_terms(whole_rows.slice(at, size) for at in range(0, len(rows), size)):
            for r in frame.to_pandas().itertuples():
                total[frozenset((r.a, r.b))] += r.value
        return total
    whole = pair_sums(100)
    assert len(whole) == 24 and pair_sums(3) == whole
    monkeypatch.setattr(divergence, "PAIR_SUMS", 4)
    assert pair_sums(3) == whole


def test_a_term_of_many_rows_is_folded(monkeypatch):
    import pandas as pd
    rows = pd.DataFrame([("en", "x", f"s{i % 3}", 1, 1) for i in range(50)] + [("en", "y", "s1", 4, 9)],
                        columns=["lang", "term", "source", "count", "documents"])
    monkeypatch.setattr(divergence, "FOLD_ROWS", 4)
    table = pa.RecordBatch.from_pandas(rows)
    got = pd.concat(b.to_pandas() for b in divergence._merged(10)(table.slice(at, 5) for at in range(0, len(rows), 5)))
    assert got.groupby(["term", "source"])["count"].sum().to_dict() == {
        ("x", "s0"): 17, ("x", "s1"): 17, ("x", "s2"): 16}


def test_edge_rows(spark):
    check(spark, EDGE_ROWS)
    check(spark, EDGE_ROWS, least=1)
    check(spark, [])
    check(spark, [(1, "word " * 5, None, None)] * 12)
    check(spark, [(i, "same words", "en", f"s{i % 3}") for i in range(30)])  # ties in every value


def test_terms_of_a_very_long_text(monkeypatch):
    text = "añb, Cd9e " * 3_000
    def counted():
        return sum((Counter(part) for part in divergence.terms_of(text)), Counter())
    whole = counted()
    monkeypatch.setattr(divergence, "SLICE", 17)
    assert counted() == whole == Counter({"añb".encode(): 3000, b"cd": 3000, b"e": 3000})


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(
        divergence.rate(F.lit(10**15 + 7), F.lit(3 * 10**15 + 11)).alias("p"),
        divergence.divergence(F.lit(10**9 + 1).cast("long"), F.lit(1)).alias("f")).first()
    assert row.p == 1 + 10**9 * (10**15 + 9) // (3 * 10**15 + 11) and row.f == (10**9) ** 2 // (10**9 + 2)
