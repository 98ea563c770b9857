"""Filling containers of fixed capacity with items of varying length.

The plan is made on the histogram of lengths, at most one count per length up to the capacity, so it
is small whatever the number of items: best fit, longest first, applied to all items of a length at
once. Items then take the planned slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of one length that one task ranks, about.
TASK_ITEMS = 500_000
_PLAN = "n_tokens bigint, before array<bigint>, steps array<struct<first:bigint,last:bigint,container:bigint,each:bigint,fill:bigint>>"


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Steps per length, and the number of containers.

    Items of length L with ranks ``first <= rank < last`` go to containers from ``container`` on,
    ``each`` items to one, the first of them at offset ``fill``. Containers with equal room are kept
    as ranges of numbers. An item goes where the least room remains; the container stays the best for
    its next equal while one fits, so a range takes ``room // L`` items for each of its containers.
    """
    steps: dict[int, list[tuple[int, int, int, int, int]]] = {}
    ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    containers = 0

    def put(room: int, start: int, count: int) -> None:
        if room and count:
            if room not in ranges:
                insort(rooms, room)
            ranges.setdefault(room, []).append((start, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"an item of {length} exceeds the capacity {capacity}")
        left, rank, out, after = histogram[length], 0, [], []
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, count = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, start = capacity, containers
                count = -(-left // (capacity // length))
                containers += count
            each = room // length
            used = min(count, -(-left // each))
            placed = min(left, used * each)
            out.append((rank, rank + placed, start, each, capacity - room))
            full, rest = divmod(placed, each)
            after += [(room - each * length, start, full), (room - rest * length, start + full, 1 if rest else 0)]
            put(room, start + used, count - used)
            rank, left = rank + placed, left - placed
        for entry in after:
            put(*entry)
        steps[length] = out
    return steps, containers


def pieces_within(items: DataFrame, key: str, capacity: int) -> DataFrame:
    """key, piece_no, token_start, n_tokens: items in one piece, those above the capacity in full pieces and a rest."""
    count = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("bigint")
    exploded = items.select(key, F.col("n_tokens").alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("_i"))
    return exploded.select(key, (F.col("_i") + 1).cast("int").alias("piece_no"), (F.col("_i") * capacity).alias("token_start"), F.least(F.col("_n") - F.col("_i") * capacity, F.lit(capacity)).alias("n_tokens"))


def pack(items: DataFrame, key: str, capacity: int = 2048, task_items: int = TASK_ITEMS) -> DataFrame:
    """key, piece_no, token_start, n_tokens, container_id, container_offset for all items.

    ``items`` has ``key`` (unique, not null) and n_tokens; they are read three times and ought to be
    stored. Only an item above ``capacity`` is divided. Items of no tokens take no room: they stand
    at the start of container 0. No items give no rows. A length that more than ``task_items`` items
    share is ranked in several parts, salted by the key, whose counts shift the ranks of the parts
    after them. What the driver gets is a count per length, at most ``capacity + 1``, and a count per
    part, which adds one for every ``task_items`` items.
    """
    spark = items.sparkSession
    pieces = pieces_within(items.select(key, F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens")), key, capacity)
    histogram = {r.n_tokens: r.n for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(n, -(-c // task_items)) for n, c in histogram.items()], "n_tokens bigint, _parts int")
    salted = pieces.join(F.broadcast(parts), "n_tokens").withColumn("_salt", F.pmod(F.xxhash64(key, "piece_no"), F.col("_parts")).cast("int")).drop("_parts")
    in_part = {(r.n_tokens, r._salt): r.n for r in salted.groupBy("n_tokens", "_salt").agg(F.count("*").alias("n")).collect()}
    steps, _ = best_fit(histogram, capacity)
    if 0 in histogram:
        steps[0] = [(0, histogram[0], 0, histogram[0], 0)]
    rows = []
    for n, own in steps.items():
        sizes = [in_part.get((n, i), 0) for i in range(-(-histogram[n] // task_items))]
        rows.append((n, [sum(sizes[:i]) for i in range(len(sizes))], own))
    within = Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece_no")
    ranked = salted.withColumn("_nth", F.row_number().over(within) - 1).join(F.broadcast(spark.createDataFrame(rows, _PLAN)), "n_tokens")
    placed = ranked.withColumn("_rank", F.col("_nth") + F.get("before", F.col("_salt"))).withColumn("_step", F.get(F.filter("steps", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["last"])), F.lit(0)))
    nth = F.col("_rank") - F.col("_step.first")
    return placed.select(
        key,
        "piece_no",
        "token_start",
        "n_tokens",
        F.expr("_step.container + (_rank - _step.first) div _step.each").alias("container_id"),
        (F.col("_step.fill") + (nth % F.col("_step.each")) * F.col("n_tokens")).alias("container_offset"),
    )


def packing_summary(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: n_pieces, n_containers, n_tokens, the least possible number of containers, and the share of room that is used."""
    total = F.coalesce(F.sum("n_tokens"), F.lit(0))
    per = packed.groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n_tokens"))
    return per.agg(F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), F.count("*").alias("n_containers"), total.alias("n_tokens"), F.max("n_tokens").alias("fullest")).select(
        "*", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("used_share")
    )
