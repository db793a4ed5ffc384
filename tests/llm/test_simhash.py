import random
import re

import xxhash

from knockon.llm import components, simhash
from tests.llm.helpers import EDGE_ROWS, docs


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(distance):
    return lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= distance


def test_fingerprint_matches_definition():
    draw = random.Random(3)
    texts = ["", None, "one", "One two", "a b c", " \t x\x0by \r\n", "é É z w", "a " * 500]
    texts += [" ".join(draw.choice("ab cd EF gé hi".split()) for _ in range(draw.randint(1, 200))) for _ in range(30)]
    for text in texts:
        assert simhash.fingerprint(text) == brute_print(text), text
    long = " ".join(str(i) for i in range(simhash.COUNT_CHUNK + 100))
    assert simhash.fingerprint(long) == brute_print(long)


def prints(draw, hubs, members, flips):
    out = set()
    for _ in range(hubs):
        hub = draw.getrandbits(64)
        for _ in range(members):
            x = hub
            for _ in range(draw.randint(0, flips)):
                x ^= 1 << draw.randrange(64)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def test_links_give_the_components_of_all_pairs(spark):
    draw = random.Random(5)
    values = prints(draw, 12, 30, 3) + prints(draw, 1, 150, 2)
    for distance in (1, 2):
        table = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")
        links = [(r.a, r.b) for r in simhash.near_links(table, distance).collect()]
        assert all(near(distance)(a, b) for a, b in links)
        want = brute_components(sorted(set(values)), near(distance))
        edges = set(links) | {(b, a) for a, b in links}
        assert brute_components(sorted(set(values)), lambda a, b: (a, b) in edges) == want


def test_crowded_keys_and_small_keys_agree(spark, monkeypatch):
    values = prints(random.Random(8), 3, 60, 3)
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_components(values, near(2))
    for bucket in (2, 8, 1000):
        monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
        links = simhash.near_links(table, 2)
        got = {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(7, 7), (3, 4)], "a long, b long")
    got = components.connected_components(edges, "a", "b").collect()
    assert len(got) == 501 and {r.component for r in got} == {0}
    none = components.connected_components(edges.where("a < 0"), "a", "b")
    assert none.count() == 0


def test_groups_match_brute_force_on_edge_rows(spark):
    rows = EDGE_ROWS + [(20, "Same text here"), (21, "x y z"), (22, "X Y Z")]
    got = simhash.near_groups(docs(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    parts = brute_components(sorted({brute_print(t) for _, t in rows}), near(2))
    least = {}
    for i, t in rows:
        if i is not None:
            least[parts[brute_print(t)]] = min(i, least.get(parts[brute_print(t)], i))
    want = sorted(((i, f"{brute_print(t):016x}", least.get(parts[brute_print(t)])) for i, t in rows), key=repr)
    assert sorted(((r.id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_drop_keeps_one_row_of_each_group(spark):
    table = docs(spark, EDGE_ROWS, clash=True)
    left = simhash.drop_near_duplicates(table)
    parts = brute_components(sorted({brute_print(t) for _, t in EDGE_ROWS}), near(2))
    assert left.columns == table.columns and left.count() == len(set(parts.values()))
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0
