import math
from collections import defaultdict

import pytest

from knockon.llm import mixing
from tests.llm.helpers import EDGE_ROWS, docs


def corpus(spark):
    rows, n = [], 0
    for source, count in (("big", 600), ("mid", 150), ("small", 40), (None, 10), ("empty", 5)):
        for i in range(count):
            text = None if source == "empty" else " ".join(["w"] * (1 + (i * 7) % 30))
            rows.append((n, text, "en", source))
            n += 1
    return docs(spark, rows, clash=True)


def shares(rows):
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source] += r.n_tokens
    return dict(tokens)


def weights(tokens, a):
    total = sum(tokens.values())
    power = {s: (n / total) ** a for s, n in tokens.items() if n}
    return {s: x / sum(power.values()) for s, x in power.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values() if x)


def bisected(fits, low, high):
    if fits(low):
        return low
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@pytest.mark.parametrize("share,repeats,budget", [(0.9, None, None), (None, 3.0, None), (0.95, 2.0, 20_000),
                                                  (0.3, None, 5000), (None, None, 4000), (1.0, None, None)])
def test_weights_and_budgets_match_brute_force(spark, share, repeats, budget):
    rows = mixing.plan(corpus(spark), budget=budget, entropy_share=share, repeats=repeats).collect()
    assert len(rows) == 805
    tokens = shares(rows)
    total, goal = sum(tokens.values()), budget or sum(tokens.values())
    full = sum(1 for n in tokens.values() if n)
    candidates = [0.0] if share or repeats else [1.0]
    if share:
        candidates.append(bisected(lambda a: entropy(weights(tokens, a)) <= share * math.log(full) + 1e-12, 0.0, 8.0))
    if repeats:
        candidates.append(bisected(lambda a: max(
            w * goal / tokens[s] for s, w in weights(tokens, a).items()) <= repeats, 0.0, 1.0))
    want = weights(tokens, max(candidates))
    longest, drawn = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.weight == pytest.approx(want.get(r.source, 0.0), abs=1e-6)
        longest[r.source] = max(longest[r.source], r.n_tokens)
        drawn[r.source] += r.n_tokens * r.copies
    for source, w in want.items():
        assert w * goal - longest[source] - 1e-3 <= drawn[source] <= w * goal + 1e-3
        copies = {r.copies for r in rows if r.source == source and r.n_tokens}
        assert max(copies) - min(copies) <= 1
        assert max(copies) <= math.ceil(w * goal / tokens[source] + 1e-9)
    assert all(r.copies == 0 for r in rows if r.source == "empty")


def test_partial_epoch_takes_whole_blocks_in_their_order(spark):
    planned = mixing.plan(corpus(spark), budget=3000)
    rows = [r for r in planned.collect() if r.source == "big"]
    by_block = defaultdict(set)
    for r in rows:
        by_block[r.block].add(r.copies)
    assert sum(len(c) > 1 for c in by_block.values()) <= 1
    plan = mixing.schedule(planned).collect()
    assert sum(1 for _ in plan) == sum(r.copies for r in planned.collect())
    assert all(0 <= r.position <= 1 for r in plan)


def test_epochs_have_orders_of_their_own(spark):
    plan = mixing.schedule(mixing.plan(corpus(spark), budget=40_000)).where("source = 'mid'").collect()
    orders = defaultdict(list)
    for r in sorted(plan, key=lambda r: r.position):
        orders[r.epoch].append(r.id)
    assert len(orders) > 2 and orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_mix_keeps_columns_and_edges(spark):
    table = docs(spark, EDGE_ROWS, clash=True)
    out = mixing.mix(table, repeats=2.0)
    assert out.columns == table.columns + ["mix_weight", "mix_copies"]
    assert all(r.mix_copies >= 1 for r in out.collect())
    again = mixing.mix(out, repeats=2.0)
    assert again.columns == out.columns
    assert mixing.plan(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    blank = mixing.plan(docs(spark, [(1, None), (2, " ")]), entropy_share=0.9).collect()
    assert [r.copies for r in blank] == [0, 0]


def test_plan_is_the_same_again(spark):
    one, two = (sorted((r.row, r.copies) for r in mixing.plan(corpus(spark), entropy_share=0.95, repeats=4.0).collect())
                for _ in range(2))
    assert one == two


def even_corpus(spark, sizes):
    return docs(spark, [(i, " ".join(["w"] * n), "en", f"s{i}") for i, n in enumerate(sizes)])


def test_nearly_even_sources_meet_the_target_or_stay_natural(spark):
    sizes = [1000 + i for i in range(20)]
    table, goal = even_corpus(spark, sizes), 0.95 * math.log(20)
    steep = {r.source: r.weight for r in mixing.plan(table, entropy_share=0.95, repeats=4.0).collect()}
    assert entropy(steep) == pytest.approx(goal, abs=1e-6) and entropy(steep) <= goal + 1e-9
    with pytest.warns(UserWarning, match="natural mix"):
        rows = mixing.plan(table, entropy_share=0.95, repeats=4.0, sharpen=False).collect()
    assert all(r.copies == 1 and r.weight == pytest.approx(r.n_tokens / sum(sizes)) for r in rows)
    skewed = even_corpus(spark, [5000, 300, 20])  # natural below the target: flattened as ever
    one, two = ({r.source: r.weight for r in mixing.plan(skewed, entropy_share=0.95, sharpen=s).collect()}
                for s in (True, False))
    assert one == pytest.approx(two)


def test_targets_that_cannot_be_met_raise(spark):
    with pytest.raises(ValueError, match="tie"):
        mixing.plan(even_corpus(spark, [100] * 4), entropy_share=0.5)
    with pytest.raises(ValueError, match="repeated"):
        mixing.plan(even_corpus(spark, [100, 101, 102]), entropy_share=0.1, repeats=1.5)
    with pytest.raises(ValueError, match="repeated"):
        mixing.plan(even_corpus(spark, [100, 50]), budget=900, repeats=2.0)


def test_exponent_one_takes_every_document_once(spark):
    assert {r.copies for r in mixing.plan(even_corpus(spark, range(1, 60))).collect()} == {1}


def test_registered_mix_flattens_the_documents_as_brute_force_does(spark):
    from knockon.llm import queries
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.plan(table, flatten=queries.MIX_FLATTEN, repeats=queries.MIX_REPEATS).collect()
    tokens = shares(rows)
    total, natural = sum(tokens.values()), entropy(weights(tokens, 1.0))
    target = natural + queries.MIX_FLATTEN * (math.log(len(tokens)) - natural)
    exponent = bisected(lambda a: entropy(weights(tokens, a)) <= target + 1e-12, 0.0, 1.0)
    exponent = max(exponent, bisected(lambda a: max(
        w * total / tokens[s] for s, w in weights(tokens, a).items()) <= queries.MIX_REPEATS, 0.0, 1.0))
    assert exponent < 0.95
    want = weights(tokens, exponent)
    assert all(abs(r.weight - want[r.source]) < 1e-6 for r in rows)
    assert {r.copies for r in rows} >= {0, 1, 2}
    drawn = {s: sum(r.n_tokens * r.copies for r in rows if r.source == s) for s in tokens}
    longest = max(r.n_tokens for r in rows)
    assert all(want[s] * total - longest - 1 <= n <= want[s] * total + 1 for s, n in drawn.items())
    out = queries.op4_temperature_mixing(spark, sf).collect()
    assert len(out) == sum(r.copies for r in rows) and max(r.epoch for r in out) == 1


def test_repetition_limit_binds(spark):
    rows = mixing.plan(corpus(spark), flatten=0.9, repeats=1.1).collect()
    tokens = shares(rows)
    total = sum(tokens.values())
    passes = {s: next(r.weight for r in rows if r.source == s) * total / n for s, n in tokens.items() if n}
    assert abs(max(passes.values()) - 1.1) < 1e-6


def test_passes_of_other_exponents_have_the_same_plan(spark):
    p = [0.5, 0.3, 0.2]
    table = spark.createDataFrame([(math.log(x), math.log(x / 0.5)) for x in p], "log_share double, below double")
    exponents = [0.0, 0.25, 1.0, 3.0]
    for (z, e, m), a in zip(mixing._sums(table, exponents), exponents, strict=True):
        q = [x / 0.5 for x in p]
        assert z == pytest.approx(sum(x ** a for x in q)) and m == pytest.approx(max(x ** a / s for x, s in zip(q, p)))
        assert e == pytest.approx(sum(x ** a * math.log(x) for x in q))
    passes = [mixing._sums_table(table, exponents[:n]).columns for n in (1, 4)]
    assert passes[0] == passes[1] == ["i", "z", "e", "m"]
