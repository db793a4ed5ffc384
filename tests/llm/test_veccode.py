"""Vector codes against a plain assignment of every part to every entry."""

import hashlib
import math
import random

from knockon.llm import veccode

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=4):
    """{position: (code, error, label_error)} of the kept rows and the codebooks' digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = -(-length // 4) * 4
    ints = [[math.floor(1024 * x) for x in r[1]] + [0] * (width - length) if len(r[1]) == length else None
            for r in kept]
    whole = [v for v in ints if v is not None]
    size = width // 4

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def cut(v, p):
        return v[p * size:(p + 1) * size]
    books = [[cut(v, p) for v in whole[:256]] for p in range(4)]

    def assign(p):
        return [min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for v in whole]
    for _ in range(rounds):
        for p in range(4):
            members = {}
            for (_, i), v in zip(assign(p), whole):
                members.setdefault(i, []).append(cut(v, p))
            for i, own in members.items():
                books[p][i] = [sum(col) // len(own) for col in zip(*own)]
    last = list(zip(*[assign(p) for p in range(4)]))
    found = iter(last)
    out = []
    for r, v in zip(kept, ints):
        if v is None:
            out.append((r[0], r[2], None, None))
            continue
        cells = next(found)
        error = sum(d for d, _ in cells)
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in cells), error if error < 1 << 63 else None))
    sums = {}
    for _, label, _, error in out:
        if error is not None:
            sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, label, c, e, s if (s := sums.get(label)) is not None and s < 1 << 63 else None)
                   for i, label, c, e in out), key=repr), digest


def check(spark, rows, schema=ROWS):
    got = veccode.compress(spark.createDataFrame(rows, schema)).collect()
    want, digest = brute(rows)
    assert sorted(((r.id, r.label, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def vectors(draw, n, width, spread=1.0):
    centres = [[draw.gauss(0, spread) for _ in range(width)] for _ in range(7)]
    return [[float(c + draw.gauss(0, 0.1)) for c in draw.choice(centres)] for _ in range(n)]


def test_matches_plain_assignment(spark):
    import numpy as np
    draw = random.Random(1)
    rows = [(i, [float(np.float32(x)) for x in v], i % 5 or None)
            for i, v in enumerate(vectors(draw, 500, 16))]
    rows += [(1000 + i, rows[3][1], 9) for i in range(200)]  # a large group of copies
    draw.shuffle(rows)
    check(spark, rows)


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.25, 0.0, 1.0, 2.0], 1), (1, [0.5, -0.25, 0.0, 1.0, 2.0], None),
            (None, [1.0] * 5, 2), (2, None, 1), (3, [1.0, None, 2.0, 3.0, 4.0], 1), (4, [nan] * 5, 1),
            (5, [inf, 1.0, 1.0, 1.0, 1.0], 1), (6, [1.0, 2.0], 1), (7, [], 3), (8, [-0.0] * 5, 1)]
    check(spark, rows)
    check(spark, [(7, [], 3), (8, [1.0], 3)])
    assert veccode.compress(spark.createDataFrame(rows, ROWS).where("vec_id > 99")).count() == 0


def test_huge_components_are_exact(spark):
    rows = [(i, [float(i % 7), 2.0 ** (i % 60), -2.0 ** 20 * i, 1.0, 0.5, 0.25, 3.0, float(i)], i % 3)
            for i in range(120)]
    rows += [(500, [2.0 ** 100] * 8, 1), (501, [1.0] * 8, 1)]
    check(spark, rows)


def test_extra_columns_that_clash(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0], i % 2) for i in range(10)]
    table = spark.createDataFrame(rows, ROWS).selectExpr(
        "*", "1 AS id", "2 AS vector", "3 AS reach", "4 AS code", "5 AS error", "6 AS of", "7 AS total")
    assert veccode.compress(table).count() == 10


def test_pruning_leaves_out_evaluations():
    import numpy as np
    draw = random.Random(4)
    rows = [[round(1024 * x) for x in v] for v in vectors(draw, 256, 4, spread=2.0)]
    book = veccode.Codebook(rows, veccode.choose_pivots(rows))
    reach = np.array([[veccode._root(veccode._squared(r, p)) for p in book.pivots] for r in rows])
    best = np.zeros(len(rows))
    visited = (book.bounds(reach) <= best[:, None]).sum()
    assert visited < 0.2 * len(rows) ** 2
