import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from hemicycle.llm import pairs


def brute(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    both, single = Counter(), Counter()
    for s in baskets.values():
        single.update(s)
        both.update(combinations(sorted(s, key=lambda x: x.encode()), 2))
    return {(a, b, n, single[a], single[b], len(baskets)) for (a, b), n in both.items()}


@pytest.mark.parametrize(("density", "group", "width", "spread"), [(1, 1024, 64, 9), (4, 3, 2048, 9), (32, 1024, 3, 0), (10_000, 1024, 7, 9), (10_000, 1024, 2048, 0), (1, 2, 2048, 9), (6, 2, 2, 0), (6, 2, 3, 9)])
def test_all_pairs_are_counted(spark, monkeypatch, density, group, width, spread):
    """Everything light, mixed, or everything heavy; one tile and many; baskets of one group and of several; broadcast and shuffled."""
    monkeypatch.setattr(pairs, "HEAVY_DENSITY", density)
    monkeypatch.setattr(pairs, "GROUP", group)
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", spread)
    rng = random.Random(density)
    items = [f"i{k}" for k in range(40)] + ["Á", "z"]
    rows = [(rng.randrange(60), items[min(int(rng.expovariate(0.15)), 41)]) for _ in range(900)]
    rows += rows[:50] + [(None, "i1"), (3, None), (999, "alone")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "basket int, item string, code string, n int")
    got = {tuple(r)[:6] for r in pairs.pair_counts(df, "basket", "item", width=width).collect()}
    assert got == brute(rows)
    frequent = {tuple(r)[:6] for r in pairs.pair_counts(df, "basket", "item", least=8, share=6, width=width).collect()}
    assert frequent == {x for x in brute(rows) if min(x[3], x[4]) >= max(8, -(-x[5] // 6))}


def test_items_of_one_bucket_stay_apart(spark, monkeypatch):
    """Items whose hashes agree: the rare ones do not add to the pairs of the frequent ones, whether they are wanted or not."""
    monkeypatch.setattr(pairs, "BUCKETS", 1)
    rows = [(b, i) for b in range(50) for i in ("often", "too")] + [(b, f"rare{b}") for b in range(50)] + [(1000 + b, "else") for b in range(3000)]
    df = spark.createDataFrame(rows, "basket int, item string")
    assert {tuple(r)[:6] for r in pairs.pair_counts(df, "basket", "item", least=5).collect()} == {("often", "too", 50, 50, 50, 3050)}
    assert {tuple(r)[:6] for r in pairs.pair_counts(df, "basket", "item").collect()} == brute(rows)


def test_many_heavy_items_in_little_memory():
    """20,000 heavy items: a worker holds the counts of one tile, not of all pairs."""
    n, width, rng = 20_000, 2048, np.random.default_rng(5)
    ranges = -(-n // width)
    baskets = [np.unique(rng.integers(0, n, 60)) for _ in range(400)]
    expected = Counter(p for b in baskets for p in combinations((-1 - b).tolist()[::-1], 2))
    cells = {}
    for b in baskets:
        for i in range(ranges):
            for j in range(i, ranges):
                one, other = b[b // width == i], b[b // width == j] if i != j else b[:0]
                cells.setdefault(i * ranges + j, []).append((i * ranges + j, (-1 - one).tolist(), (-1 - other).tolist(), [], [], 0))
    schema = pa.schema([("tile", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("heavy", "heavy_other", "light", "light_other")), ("low", pa.int32())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema) for _, rows in sorted(cells.items())]
    got = Counter()
    tracemalloc.start()
    for batch in pairs._count(iter(batches), n, width):
        for a, b, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[a, b] += k
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == expected and peak < 500e6


@pytest.mark.parametrize("held", [1, 50, 2_000_000])
def test_blocks_are_summed(monkeypatch, held):
    monkeypatch.setattr(pairs, "HELD", held)
    monkeypatch.setattr(pairs, "SENT", held // 2)
    rng = np.random.default_rng(2)
    counter, expected, batches = pairs._Counter(6, 6), Counter(), []
    batches += counter.open(0)
    for _ in range(4):
        heavy = rng.random((6, 100)) < 0.4
        light = rng.random((30, 100)) < 0.03
        (h, hb), (lt, lb) = np.nonzero(heavy), np.nonzero(light)
        batches += counter.block(-1 - h, hb, lt + 100, lb, np.ones(100, bool))
        for b in range(100):
            present = [*(-1 - np.flatnonzero(heavy[:, b])).tolist(), *(np.flatnonzero(light[:, b]) + 100).tolist()]
            expected.update(combinations(sorted(present), 2))
    batches += counter.across(np.arange(200, 230), np.arange(300, 309))
    expected.update((a, b) for a in range(200, 230) for b in range(300, 309))
    got = Counter()
    for batch in [*batches, *counter.drain()]:
        for a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[a, b] += n
    assert got == expected


def test_lift_and_cases(spark):
    rows = [(b, i) for b in range(100) for i in (["a", "b"] if b < 10 else ["c"])]
    counted = pairs.pair_counts(spark.createDataFrame(rows, "b int, i string"), "b", "i")
    assert [(r.item_a, r.item_b, r.n_both, r.lift) for r in counted.collect()] == [("a", "b", 10, 10.0)]
    assert pairs.clearly_together(counted).count() == 1
    assert pairs.clearly_together(counted, least=11).count() == pairs.clearly_together(counted, factor=11).count() == pairs.clearly_together(counted, share=9).count() == 0


def test_empty(spark):
    assert pairs.pair_counts(spark.createDataFrame([], "b int, i string"), "b", "i").count() == 0
    assert pairs.pair_counts(spark.createDataFrame([(1, "a"), (None, "b")], "b int, i string"), "b", "i").count() == 0
