"""Items that appear together: pair counts and lift over all baskets.

Heavy-light decomposition. A heavy item is in at least one of ``HEAVY_DENSITY`` baskets: there a
bitmap of one bit per basket is smaller than a list of basket numbers. Per block of baskets, heavy
pairs are counted by popcounts over the rows of a dense bit matrix, mixed pairs by probing the bit
matrix at the baskets in the light item's list, and light pairs by hashing the pairs of the few light
items of each basket. The partial counts of the blocks are summed per pair.

Items are numbered by a dictionary: heavy ones -1, -2, ... in byte order, light ones from 0 on within
buckets of a hash, so that no two items share a number. There are at most HEAVY_DENSITY times the
mean basket size of heavy items; the square of their counts is cut into tiles of ``TILE`` by ``TILE``,
which are a shuffle key, so a worker holds one tile at a time. The light items of a basket are dealt to groups of
about GROUP; each two groups of a basket meet in a row of their own, so that a basket of any size
spreads over tasks and no row holds more than two groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.session import materialise

#: An item is heavy from one in so many baskets.
HEAVY_DENSITY = 32
#: Heavy items on a side of one tile of the counts; a tile takes 8 * TILE * TILE bytes.
TILE = 2048
#: Baskets of one block of the bit matrix.
BLOCK = 8192
#: Light items of one basket that stand in one group, about.
GROUP = 1024
#: Pairs that a task holds before it merges equal ones, and merged pairs before it sends them on.
HELD, SENT = 2_000_000, 1_000_000
#: Buckets within which light items are numbered.
BUCKETS = 4096
#: Heavy items, or baskets of several groups, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_COUNTS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


class _Counter:
    """Pair counts of one task: heavy pairs of one tile in a matrix, others as sorted code pairs."""

    def __init__(self, heavy: int, width: int) -> None:
        self.heavy, self.width, self.ranges = heavy, width, max(1, -(-heavy // width))
        self.tile = -1
        self.dense = np.zeros((0, 0), np.int64)
        self.sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def open(self, tile: int) -> Iterator[pa.RecordBatch]:
        """Turn to a tile; the counts of the one before are sent on."""
        if tile != self.tile:
            yield from self._closed()
            sides = [min(self.width, self.heavy - i * self.width) for i in divmod(tile, self.ranges)]
            self.tile, self.dense = tile, np.zeros(sides, np.int64)

    def _add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        if len(a):
            self.sparse.append((np.stack([np.minimum(a, b), np.maximum(a, b)]), n))
            self.held += len(a)

    @staticmethod
    def _bits(codes: np.ndarray, at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        here, row = np.unique(codes, return_inverse=True)
        bits = np.zeros((len(here), rows), np.uint8)
        bits[row, at] = 1
        return here, bits

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

    def _places(self, codes: np.ndarray, side: int) -> np.ndarray:
        return -codes - 1 - divmod(self.tile, self.ranges)[side] * self.width

    def block(self, heavy: np.ndarray, heavy_at: np.ndarray, light: np.ndarray, light_at: np.ndarray, first_row: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count one block of a tile on the diagonal: codes of heavy and light items with their row, and whether a row is its basket's first, in which heavy pairs count. Light pairs count in the first tile."""
        here, bits = self._bits(heavy, heavy_at, len(first_row))
        if len(here):
            words, place = self._words(bits * first_row.astype(np.uint8)), self._places(here, 0)
            for i in range(len(here) - 1):
                self.dense[place[i], place[i + 1 :]] += np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
        if not len(light):
            return
        order = np.lexsort((light_at, light))
        code, at = light[order], light_at[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        if len(here):
            for s, e in zip(starts, np.r_[starts[1:], len(code)], strict=True):
                probed = bits[:, at[s:e]].sum(axis=1, dtype=np.int64)
                hit = np.flatnonzero(probed)
                self._add(np.full(len(hit), code[s]), here[hit], probed[hit])
                yield from self._relieved()
        if self.tile:
            return
        order = np.lexsort((light, light_at))
        code, at = light[order], light_at[order]
        after = np.searchsorted(at, at, side="right") - np.arange(len(code)) - 1
        upto = np.cumsum(after)
        first = 0
        while first < len(code):  # as many left items as give HELD pairs
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - after[first] + HELD, side="right")))
            n = after[first:last]
            left = np.repeat(np.arange(first, last), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            self._add(code[left], code[right], np.ones(len(left), np.int64))
            yield from self._relieved()
            first = last

    def off_diagonal(self, left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray, rows: int) -> None:
        """Count one block of a tile between two ranges of heavy items."""
        (here, bits), (there, others) = self._bits(left, left_at, rows), self._bits(right, right_at, rows)
        words, against, place, column = self._words(bits), self._words(others), self._places(here, 0), self._places(there, 1)
        for i in range(len(here)):
            self.dense[place[i], column] += np.bitwise_count(words[i] & against).sum(axis=1, dtype=np.int64)

    def across(self, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the pairs of two groups of one basket."""
        rows = max(1, HELD // max(1, len(right)))
        for s in range(0, len(left), rows):
            part = left[s : s + rows]
            self._add(np.repeat(part, len(right)), np.tile(right, len(part)), np.ones(len(part) * len(right), np.int64))
            yield from self._relieved()

    def _relieved(self) -> Iterator[pa.RecordBatch]:
        if self.held > HELD:
            self._merge()
            if self.held > SENT:
                yield from self._sent()

    def _merge(self) -> None:
        if self.sparse:
            pairs, n = np.concatenate([p for p, _ in self.sparse], axis=1), np.concatenate([n for _, n in self.sparse])
            order = np.lexsort(pairs[::-1])
            pairs, n = pairs[:, order], n[order]
            first = np.flatnonzero(np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])
            self.sparse = [(pairs[:, first], np.add.reduceat(n, first))]
            self.held = len(first)

    @staticmethod
    def _batches(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in (a, b, n)], schema=_COUNTS)

    def _sent(self) -> Iterator[pa.RecordBatch]:
        for pairs, n in self.sparse:
            yield from self._batches(pairs[0], pairs[1], n)
        self.sparse, self.held = [], 0

    def _closed(self) -> Iterator[pa.RecordBatch]:
        if self.dense.any():
            low, high = divmod(self.tile, self.ranges)
            for s in range(0, len(self.dense), 64):
                i, j = np.nonzero(self.dense[s : s + 64])
                a, b = -1 - (i + s + low * self.width), -1 - (j + high * self.width)
                yield from self._batches(np.minimum(a, b), np.maximum(a, b), self.dense[s : s + 64][i, j])

    def drain(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        yield from self._sent()
        yield from self._closed()
        self.tile, self.dense = -1, np.zeros((0, 0), np.int64)


def _flat(column: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of all lists, and the row of each."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(rows), lengths)


def _count(batches: Iterator[pa.RecordBatch], heavy: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows as ``_basket_rows`` makes them to partial pair counts."""
    counter = _Counter(heavy, width)
    for batch in batches:
        tiles = batch.column(0).to_numpy(zero_copy_only=False)
        for row in np.flatnonzero(tiles < 0).tolist():
            yield from counter.across(*(batch.column(i)[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4)))
        for tile in np.unique(tiles[tiles >= 0]).tolist():
            yield from counter.open(tile)
            own, (low, high) = batch.filter(pa.array(tiles == tile)), divmod(tile, counter.ranges)
            for s in range(0, own.num_rows, BLOCK):
                part = own.slice(s, BLOCK)
                one, other, light = (_flat(part.column(i), part.num_rows) for i in (1, 2, 3))
                if low == high:
                    yield from counter.block(*one, *light, part.column(5).to_numpy(zero_copy_only=False) == 0)
                else:
                    counter.off_diagonal(*one, *other, part.num_rows)
    yield from counter.drain()


def _basket_rows(coded: DataFrame, sizes: DataFrame, n_large: int, heavy: int, width: int) -> DataFrame:
    """tile, heavy, heavy_other, light, light_other, low.

    Per basket, tile on the diagonal and group of light items a row with the heavy items of the range
    and the light ones of the group; per tile off the diagonal a row with the heavy items of two
    ranges; and for each two groups a row (tile -1) with their light items. ``low`` is the number of the (first) group.
    """
    ranges = max(1, -(-heavy // width))
    own = coded.withColumn("range", F.when(F.col("code") < 0, F.expr(f"cast((-code - 1) div {width} as int)")))
    if n_large:
        large = sizes.where(F.col("n") > GROUP).select("basket", F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
        own = own.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "basket", "left")
        own = own.withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("group", F.when(F.col("code") >= 0, F.pmod(F.xxhash64("code"), F.col("groups")).cast("int")))
    else:
        own = own.withColumn("groups", F.lit(1)).withColumn("group", F.when(F.col("code") >= 0, F.lit(0)))
    if n_large or ranges > 1:
        cell = lambda tile, low, high: F.struct(tile.cast("int").alias("tile"), low.cast("int").alias("low"), high.cast("int").alias("high"))
        groups, every = F.sequence(F.lit(0), F.col("groups") - 1), F.sequence(F.lit(0), F.lit(ranges - 1))
        mine, on_diagonal = F.col("range"), lambda i: i * (ranges + 1)
        of_heavy = F.concat(F.transform(groups, lambda g: cell(on_diagonal(mine), g, g)), F.transform(F.filter(every, lambda i: i != mine), lambda i: cell(F.least(i, mine) * ranges + F.greatest(i, mine), F.lit(0), F.lit(0))))
        of_light = F.concat(
            F.transform(every, lambda i: cell(on_diagonal(i), F.col("group"), F.col("group"))),
            F.transform(F.filter(groups, lambda g: g != F.col("group")), lambda g: cell(F.lit(-1), F.least(g, F.col("group")), F.greatest(g, F.col("group")))),
        )
        own = own.withColumn("cell", F.explode(F.when(mine.isNotNull(), of_heavy).otherwise(of_light))).select("basket", "code", "range", "group", "cell.*")
    else:
        own = own.select("*", F.lit(0).alias("tile"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    side = lambda when: F.collect_list(F.when(when, F.col("code")))
    first, last = F.expr(f"tile div {ranges}"), F.expr(f"tile % {ranges}")
    rows = own.groupBy("basket", "tile", "low", "high").agg(
        side(F.col("range") == first).alias("heavy"), side((F.col("range") == last) & (first != last)).alias("heavy_other"), side(F.col("group") == F.col("low")).alias("light"), side((F.col("group") == F.col("high")) & (F.col("low") != F.col("high"))).alias("light_other")
    )
    needed = F.when(F.col("tile") < 0, (F.size("light") > 0) & (F.size("light_other") > 0)).when(first != last, (F.size("heavy") > 0) & (F.size("heavy_other") > 0)).otherwise((F.col("tile") == 0) | (F.size("heavy") > 0))
    rows = rows.where(needed)
    if ranges > 1:
        tasks = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, tasks // (ranges * (ranges + 1) // 2))
        rows = rows.repartition("tile", F.pmod(F.xxhash64("basket"), F.lit(salts))).sortWithinPartitions("tile")
    return rows.select("tile", "heavy", "heavy_other", "light", "light_other", "low")


def pair_counts(rows: DataFrame, basket: str, item: str, least: int = 1, share: int | None = None, width: int = TILE) -> DataFrame:
    """item_a, item_b, n_both, n_a, n_b, n_baskets, lift for every pair of different items in a common basket.

    ``item_a`` is the smaller in byte order. A basket is the set of its items: repeated rows count
    once. Rows without basket or item are left out; no row gives no pair. Lift is n_both * N /
    (n_a * n_b). Of pairs that can't be in ``least`` baskets, or not in one of ``share`` baskets,
    since one of their items alone isn't, none are counted. ``width`` is the side of a tile of heavy
    items; it changes no result.
    """
    sets = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    sets = materialise(sets, "basket_items")
    sizes = sets.groupBy("basket").agg(F.count("*").alias("n"))
    total, n_large = sizes.agg(F.count("*"), F.count_if(F.col("n") > GROUP)).first()
    counted = sets.groupBy("item").agg(F.count("*").alias("n")).withColumn("is_heavy", F.col("n") * HEAVY_DENSITY >= total)
    counted = counted.withColumn("bucket", F.when(F.col("is_heavy"), F.lit(-1).cast("bigint")).otherwise(F.pmod(F.xxhash64("item"), F.lit(BUCKETS).cast("bigint"))))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("item")).cast("bigint")
    code = F.when(F.col("is_heavy"), -nth).otherwise((nth - 1) * BUCKETS + F.col("bucket"))
    dictionary = materialise(counted.withColumn("code", code).select("item", "n", "code"), "item_codes")
    heavy = dictionary.where("code < 0").count()
    known = dictionary.select("item", "code", (F.col("n") >= max(least, -(-total // share) if share else 1)).alias("is_wanted"))
    wanted = lambda found: found.where("is_wanted").select("basket", "code")
    if heavy <= BROADCAST_ROWS:  # a heavy item may be in most baskets: its rows are not shuffled for its number
        marked = sets.join(F.broadcast(known.where("code < 0")), "item", "left")
        light = marked.where("code is null").select("item", "basket").join(known.where("code >= 0 and is_wanted"), "item")
        coded = wanted(marked).unionByName(wanted(light))
    else:
        coded = wanted(sets.join(known, "item"))
    partial_counts = _basket_rows(coded, sizes, n_large, heavy, width).mapInArrow(partial(_count, heavy=heavy, width=width), "a bigint, b bigint, n bigint")
    counts = partial_counts.groupBy("a", "b").agg(F.sum("n").alias("n_both"))
    side = lambda x: dictionary.select(F.col("code").alias(x), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
    named = counts.join(side("a"), "a").join(side("b"), "b").withColumn("n_baskets", F.lit(total).cast("bigint"))
    turned = F.col("item_a") > F.col("item_b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return named.select(pick("item_a", "item_b").alias("item_a"), pick("item_b", "item_a").alias("item_b"), "n_both", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n_baskets").withColumn("lift", F.col("n_both") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b")))


def clearly_together(pairs: DataFrame, least: int = 5, share: int = 200, factor: int = 3) -> DataFrame:
    """Pairs in at least ``least`` baskets and one in ``share`` of all, ``factor`` times as often as by chance."""
    both, total = F.col("n_both").cast("decimal(38,0)"), F.col("n_baskets")
    return pairs.where((F.col("n_both") >= least) & (F.col("n_both") * share >= total) & (both * total >= F.col("n_a").cast("decimal(38,0)") * F.col("n_b") * factor))
