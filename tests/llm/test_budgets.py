"""Packing into containers and mixing to shares."""

import random
import time
from collections import Counter
from itertools import product

import pytest

from chronoweave.llm import mixing, packing, tokens


def test_best_two_fit_packs_all_once_and_well():
    rng = random.Random(3)
    for capacity in (7, 100, 512):
        sizes = [rng.randint(1, capacity) for _ in range(400)]
        boxes = packing.best_two_fit(sizes, capacity)
        assert sorted(i for b in boxes for i in b) == list(range(400))
        assert all(sum(sizes[i] for i in b) <= capacity for b in boxes)
        assert len(boxes) <= 1.1 * -(-sum(sizes) // capacity) + 2
    assert packing.best_two_fit([], 5) == []
    with pytest.raises(ValueError):
        packing.best_two_fit([6], 5)


def test_two_items_replace_the_smallest():
    # Greedy: 6 and 3 leave 1 of 10; 3 is replaced by 2 + 2.
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[0, 2, 3], [1]]


def test_stock_pair_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 8))]
        gap, least = rng.randint(1, 20), rng.randint(0, 10)
        sums = [a + b for i, a in enumerate(sizes) for j, b in enumerate(sizes) if i < j and least < a + b <= gap]
        for tried in (0, 2, 48):
            found = packing.Stock(sizes, 20).pair(gap, least, tried)
            assert (sum(found) if found else None) == (max(sums) if sums else None)


def test_few_items_of_a_large_capacity_take_little_time():
    rng, began = random.Random(2), time.monotonic()
    sizes = [rng.randint(1, 131_072) for _ in range(300)]
    assert sorted(i for b in packing.best_two_fit(sizes, 131_072) for i in b) == list(range(300))
    assert time.monotonic() - began < 5


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 130), "w") for i in range(300)] + [(900, 1000, "w"), (901, 0, "w"), (902, None, "w"), (903, 100, "w"), (903, 90, "w")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, window_name string")
    for per_task in (50_000, 60):
        got = packing.pack(df, [("a", 100), ("b", 40)], per_task=per_task).collect()
        want = {i: n or 0 for i, n, _ in sorted(rows, key=lambda r: r[1] or 0)}
        for window, capacity in (("a", 100), ("b", 40)):
            mine = [r for r in got if r.window_name == window]
            total, boxes = Counter(), Counter()
            for r in mine:
                total[r.doc_id] += r.size
                boxes[r.container_id] += r.size
            assert total == Counter(want) and set(total) == set(want)
            boxes.pop(None)
            assert max(boxes.values()) <= capacity
            assert all(r.container_id is None or boxes[r.container_id] == r.used for r in mine)
            assert all(r.size == capacity or r.start + r.size == want[r.doc_id] for r in mine)
    r = packing.report(packing.pack(df, [("a", 100)])).first()
    assert r.n_containers <= 1.03 * r.least_containers + 1
    assert packing.pack(df.limit(0), [("a", 100)]).count() == 0


def test_knapsack_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        lengths = [(rng.randint(1, 12), rng.randint(0, 3)) for _ in range(4)]
        lengths = list(dict(lengths).items())
        budget = rng.randint(0, 60)
        best = max(s for c in product(*(range(n + 1) for _, n in lengths)) if (s := sum(k * a for k, (a, _) in zip(c, lengths, strict=True))) <= budget)
        got = mixing.knapsack(lengths, budget)
        assert sum(a * c for a, c in got.items()) == best
        assert all(c <= dict(lengths)[a] for a, c in got.items())


def test_fit_counts_meets_the_budget():
    rng = random.Random(6)
    lengths = list(Counter(rng.randint(5, 900) for _ in range(3000)).items())
    total = sum(a * n for a, n in lengths)
    for budget in (0, 1, 4, 17, 1000, 123_457, total - 3, total, total + 5):
        got = mixing.fit_counts(lengths, budget, reserve=4096)
        used = sum(a * c for a, c in got.items())
        assert all(0 <= c <= dict(lengths)[a] for a, c in got.items())
        # Just below the total, the shortest document is the least that can be left out.
        best = total - min(dict(lengths)) if budget == total - 3 else min(budget, total)
        assert used <= budget and (used >= best - 3 or budget < 17)


def test_budgets():
    targets = [("a", 0.5, 1), ("b", 0.25, 4), ("c", 0.25, 2)]
    plan = {b.source: b for b in mixing.budgets(targets, {"a": 1000, "b": 50, "c": 400})}
    assert (plan["a"].tokens, plan["b"].tokens, plan["c"].tokens) == (400, 200, 200)
    assert (plan["b"].passes, plan["b"].rest) == (4, 0)
    assert {b.source: b.tokens for b in mixing.budgets(targets, {"a": 1000, "c": 400})} == {"a": 1000, "b": 0, "c": 500}
    assert [b.tokens for b in mixing.budgets(targets, {"a": 1000, "b": 50, "c": 400}, 2000)] == [1000, 200, 500]
    assert all(b.tokens == 0 for b in mixing.budgets(targets, {}))


@pytest.mark.parametrize("min_rows", [2_000_000, 5])
def test_mix(spark, min_rows):
    rng = random.Random(1)
    rows = [(i, "big", rng.choice([7, 11, 11, 11, 40]), 0) for i in range(600)] + [(1000 + i, "small", 13, 0) for i in range(9)] + [(2000, None, 5, 0), (2001, "other", 5, 0), (2002, "big", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, take int")
    targets = [("big", 0.8, 1), ("small", 0.2, 3)]
    mixture = mixing.mix(df, targets, min_rows=min_rows)
    got = mixture.collect()
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens * r.n_uses
        assert r.n_uses <= dict((s, m) for s, _, m in targets)[r.source]
    assert used["small"] == 3 * 9 * 13 and abs(used["big"] - 4 * used["small"]) <= 1
    assert len({r.doc_id for r in got}) == len(got)
    assert {tuple(r) for r in mixing.mix(df, targets, min_rows=2_000_000).collect()} == {tuple(r) for r in got}
    table = spark.createDataFrame([*targets, ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mix_report(mixture, table).collect()}
    assert abs(report["big"].actual_share - 0.8) < 0.001 and report["none"].used_tokens == 0
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, None, "b"), (3, "", None), (4, "x" * 20_000, "c")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_tokens(df.drop("n_tokens"), "doc_id", []).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 100
