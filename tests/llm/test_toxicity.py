import zlib

import numpy as np

from knockon.llm import toxicity
from tests.llm.helpers import EDGE_ROWS, docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row


def test_trie_walk_finds_what_edit_distance_finds():
    draw = np.random.default_rng(2)
    letters = list("abcde")
    terms = {("".join(draw.choice(letters, n)), bool(n % 2)): float(n) for n in (3, 4, 5, 6, 7, 8, 9, 10) for _ in range(3)}
    trie = toxicity.Trie(terms)
    for _ in range(800):
        word = "".join(draw.choice(letters, draw.integers(1, 12)))
        best = None
        for (term, stem), weight in terms.items():
            row = distance(term, word)
            edits = min(row) if stem else row[-1]
            if edits <= toxicity.allowed_edits(term):
                best = min(best or (99, 0, ""), (edits, -weight, term))
        got = trie.match(word)
        assert (got and (got[1], -got[2], got[0])) == best


def test_context_tells_quotation_from_abuse():
    found = toxicity.Detector({("idiot", False): 1.0})
    plain, quoted = found.features("you are an idiot"), found.features('the word "idiot" is old')
    assert plain[0] > 0 and plain[3] == 0 and plain[6] > 0
    assert quoted[0] == 0 and quoted[3] > 0 and quoted[6] == 0
    assert found.features("you are an idoit or idiott")[2] > 0
    assert found.features("don't look at it's idiot, isn't it")[0] > 0
    assert found.features(None) == found.features("") == [0.0] * 7


def test_stems_are_learned_and_held_out_labels_are_not(spark):
    draw = np.random.default_rng(6)
    words = [a + b for a in ("al", "be", "ga", "del", "om") for b in ("pha", "ta", "mma", "to", "ga", "ro", "ni", "sel")]
    rows, marks = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        text = list(draw.choice(words, 15))
        if toxic:
            text.insert(3, "zurk" + draw.choice(["ab", "ec", "id", "ok", "um"]))
        rows.append((i, " ".join(text)))
        marks.append((i, toxic))
    rows += [(900 + k, t) for k, (_, t) in enumerate(EDGE_ROWS)] + [(None, "zurkab"), (990, "he zurkxyz now")]
    marks += [(None, 1), (901, None), (5, 0), (5, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score(docs(spark, rows, clash=True), labels).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert all(by[i].predicted == int(i % 5 == 0) for i in range(400))
    assert by[990].predicted == 1 and by[None].predicted == 1
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.id is not None:
            assert r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2)
    flipped = spark.createDataFrame([(i, t if t is None or i is None or zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t)
                                     for i, t in marks], "doc_id long, toxic int")
    again = {r.id: r.score for r in toxicity.score(docs(spark, rows), flipped).collect()}
    assert all(abs(again[r.id] - r.score) < 1e-9 for r in got)


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.id: r for r in toxicity.score(docs(spark, [(1, "you idiot"), (3, "hello"), (4, None)]), none).collect()}
    assert got[1].predicted == 1 and got[3].predicted == 0 and got[4].predicted == 0
    assert toxicity.score(docs(spark, []), none).count() == 0


def test_held_out_documents_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = found.where("held_out").join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9
    assert hit / sum(r.predicted for r in rows) > 0.9


def test_empty_documents_with_labels(spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs(spark, []), labels).collect() == []
    others = docs(spark, [(1000 + i, "you utter idiot") for i in range(3)])
    assert {r.predicted for r in toxicity.score(others, labels).collect()} == {1}


def test_long_words_are_read_whole():
    long = "x" * 60 + "worm"
    trie = toxicity.Trie({(long, False): 1.0, ("filth", True): 0.5})
    assert trie.match(long) == (long, 0, 1.0) and trie.match(long[:-1] + "n")[1] == 1
    assert trie.match("x" * 60) is None and trie.match(long + "more") is None
    assert trie.match("filthy" + "z" * 100_000) == ("filth", 0, 0.5)


def test_too_many_terms_are_cut_by_evidence(spark, monkeypatch):
    rows = [(i, " ".join(["calm"] * 3 + ([f"vile{i % 5}a word{i}"] if i % 2 else [f"good{i}"])), i % 2) for i in range(400)]
    texts = spark.createDataFrame([(i, y, t) for i, t, y in rows], "id long, label int, text string")
    monkeypatch.setattr(toxicity, "STEMS", ())
    monkeypatch.setattr(toxicity, "LEAST_SETTINGS", 0)
    whole = toxicity.learn_terms(texts, {})
    monkeypatch.setattr(toxicity, "MOST_TERMS", 3)
    some = toxicity.learn_terms(texts, {})
    assert len(whole) > 3 and len(some) == 3 and some.items() <= whole.items()
