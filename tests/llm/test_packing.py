import random
from collections import defaultdict

import pytest

from hemicycle.llm import packing

SCHEMA = "doc long, n_tokens long, piece_no int, _rank int"


def packed(spark, sizes, capacity, **more):
    df = spark.createDataFrame([(i, n, 1, 1) for i, n in enumerate(sizes)], SCHEMA)
    return packing.pack(df, "doc", capacity, **more)


def one_by_one(sizes, capacity):
    """Best fit, longest first, item by item."""
    rooms = []
    for n in sorted((n for n in sizes if n), reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_item_by_item(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13, 20, 33, 50, 64, rng.randint(1, 64)]) for _ in range(400)]
    steps, n = packing.best_fit({s: sizes.count(s) for s in set(sizes)}, 64)
    used = defaultdict(int)
    for length, own in steps.items():
        assert sum(b - a for a, b, *_ in own) == sizes.count(length)
        for first, last, container, each, _ in own:
            for rank in range(first, last):
                used[container + (rank - first) // each] += length
    assert len(used) == n and sorted(64 - u for u in used.values()) == one_by_one(sizes, 64)


@pytest.mark.parametrize("task_items", [3, 500_000])
def test_every_item_stands_whole_in_one_container(spark, task_items):
    rng = random.Random(1)
    sizes = [rng.randint(1, 120) for _ in range(300)] + [50] * 200 + [0, 0, None, 64, 128, 1000]
    rows = packed(spark, sizes, 64, task_items=task_items).collect()
    taken, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        taken[r.doc].append((r.piece_no, r.token_start, r.n_tokens))
        if r.n_tokens:
            filled[r.container_id].append((r.container_offset, r.container_offset + r.n_tokens))
    assert set(taken) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        parts = sorted(taken[i])
        assert [p for p, _, _ in parts] == list(range(1, max(1, -(-(n or 0) // 64)) + 1))
        assert sum(k for *_, k in parts) == (n or 0) and all(start == 64 * (p - 1) for p, start, _ in parts)
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(filled) == list(range(len(filled)))


def test_summary_and_empty(spark):
    assert packed(spark, [], 64).count() == 0
    s = packing.packing_summary(packed(spark, [64, 32, 32, 10], 64), 64).first()
    assert (s.n_pieces, s.n_containers, s.n_tokens, s.least_containers) == (4, 3, 138, 3)
    assert packing.packing_summary(packed(spark, [], 64), 64).first().n_containers == 0
    assert [r.container_id for r in packed(spark, [0], 64).collect()] == [0]
