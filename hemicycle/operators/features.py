"""Per-entity feature tables from events.

Two stages where a group is heavy: partial statistics per (entity, event type, salt), where the salt
spreads the group over tasks, then a merge of the partial statistics per (entity, event type). Groups
of entities that are not heavy pass one exchange only. The expansion to the complete list of types is
an array per entity, not a column per type, so that its width may follow the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is heavy from one in so many rows; there are no more heavy keys than that.
HEAVY_SHARE = 512
#: Tasks over which a heavy key is spread.
SALTS = 16
#: Event types that are broadcast; more are joined by a shuffle.
BROADCAST_TYPES = 100_000


def first_deliveries(events: DataFrame, event_id: str, time: str) -> DataFrame:
    """One row per ``event_id``, with the earliest ``time`` and the least value of each other column.

    Deliveries of an event differ in their time; where they differ in another column, too, its
    least value that is not null stands for all. Rows without ``event_id`` are one event.
    """
    return events.groupBy(event_id).agg(*[F.min(c).alias(c) for c in events.columns if c != event_id]).select(*events.columns)


def heavy_keys(rows: DataFrame, *columns: str, share: int = HEAVY_SHARE) -> list[list]:
    """For each column the values that at least one in ``share`` of all rows has, null left out: at most ``share`` values of each come to the driver. All rows are counted, in one reading and combined before they are shuffled."""
    least = max(rows.count() / share, 1.0)
    which = F.coalesce(*[F.when((F.grouping(c) == 0) & F.col(c).isNotNull(), i) for i, c in enumerate(columns)])
    counts = rows.select(*columns).groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), which.alias("which"))
    found = counts.where((F.col("n") >= least) & F.col("which").isNotNull()).collect()
    return [sorted(r[c] for r in found if r.which == i) for i, c in enumerate(columns)]


def join_hot(rows: DataFrame, others: DataFrame, key: str, hot: Sequence, spread: str, salts: int = SALTS) -> DataFrame:
    """Inner join on ``key``, which ``others`` has once: rows of a hot key are spread over ``salts`` by the column ``spread``, and the row of ``others`` goes to each. Rows without key join nothing."""
    if not hot:
        return rows.join(others, key)
    is_hot = F.col(key).isin(list(hot))
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.hash(spread), F.lit(salts))).otherwise(0))
    copies = others.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def event_statistics(events: DataFrame, entity: str, event_type: Column, time: str, event_id: str, entities: DataFrame | None = None, hot: Sequence = (), salts: int = SALTS) -> DataFrame:
    """entity, event_type, n_events, last_at: one row per entity and type with an event.

    Events without entity or type are left out, and those whose entity is not in the column
    ``entity`` of ``entities``, where it is given; ``last_at`` is null if no event of the group has a
    time. ``hot`` are the heavy entities (see ``heavy_keys``): their events are salted by
    ``event_id`` and pass two stages. The events of the others meet the entities and are counted in
    one exchange, by entity. What is hot changes no result.
    """
    typed = events.select(F.col(entity).alias("entity"), event_type.alias("event_type"), F.col(time).alias("at"), F.col(event_id).alias("event")).where("entity is not null and event_type is not null")
    known = None if entities is None else entities.select(F.col("entity").alias("_known")).distinct()
    n, last = F.count("*").alias("n_events"), F.max("at").alias("last_at")

    def kept(rows: DataFrame, of: DataFrame | None) -> DataFrame:
        return rows if of is None else rows.join(of, F.col("entity") == F.col("_known"), "left_semi")

    if not hot:
        return kept(typed, known).groupBy("entity", "event_type").agg(n, last)
    is_hot = F.col("entity").isin(list(hot))
    light = kept(typed.where(~is_hot), known).groupBy("entity", "event_type").agg(n, last)
    few = None if known is None else F.broadcast(known.where(F.col("_known").isin(list(hot))))
    partial = kept(typed.where(is_hot), few).withColumn("salt", F.pmod(F.hash("event"), F.lit(salts))).groupBy("entity", "event_type", "salt").agg(n, last)
    return light.unionByName(partial.groupBy("entity", "event_type").agg(F.sum("n_events").alias("n_events"), F.max("last_at").alias("last_at")))


def days_before(time: Column, as_of: str) -> Column:
    """Whole days of 24 hours from ``time`` to ``as_of``, rounded down."""
    return F.extract(F.lit("DAY"), F.lit(as_of).cast("timestamp_ntz") - time.cast("timestamp_ntz")).cast("int")


def feature_table(statistics: DataFrame, entities: DataFrame, entity: str, types: DataFrame, as_of: str) -> DataFrame:
    """One row per distinct entity of ``entities`` with features for the complete list of types.

    Result: entity, n_events, features: array<struct<event_type, n_events, days_since_last, share>>
    in the order of event_type; a type without event has 0, null and 0.0. ``types`` has the column
    event_type; its distinct values are a scalar subquery, whose size is that of the list of types,
    not of the data. Events of other types count in n_events and in the shares only. Entities
    without event get the whole list, too. The types of an entity stand in the order of their
    numbers, and the gaps between them are slices of a list of zeros: time is in proportion to the list.
    """
    listed = types.select("event_type").where("event_type is not null").distinct().agg(F.array_sort(F.collect_list("event_type")).alias("types"))
    numbers = listed.select(F.posexplode("types").alias("no", "event_type"))
    numbered = statistics.join(F.broadcast(numbers) if numbers.count() <= BROADCAST_TYPES else numbers, "event_type", "left")
    stat = F.struct("no", F.col("n_events").alias("n"), days_before(F.col("last_at"), as_of).alias("days"))
    per_entity = numbered.groupBy("entity").agg(F.sum("n_events").alias("total"), F.array_sort(F.collect_list(F.when(F.col("no").isNotNull(), stat))).alias("present"))
    everyone = entities.select(F.col(entity).alias("entity")).where("entity is not null").distinct()
    none = F.lit(0).cast("bigint")

    def feature(event_type: Column, n: Column, days: Column, share: Column) -> Column:
        return F.struct(event_type.alias("event_type"), n.alias("n_events"), days.alias("days_since_last"), share.alias("share"))

    present, zeros = F.coalesce("present", F.array().cast(per_entity.schema["present"].dataType)), F.col("zeros")
    wide = everyone.join(per_entity, "entity", "left").select("entity", "total", present.alias("present"), listed.scalar().alias("types"))
    wide = wide.withColumn("zeros", F.transform("types", lambda t: feature(t, none, F.lit(None).cast("int"), F.lit(0.0))))
    number = lambda i: F.coalesce(F.get("present", i)["no"], F.lit(-1))
    gap = lambda after, before: F.slice(zeros, after + 2, before - after - 1)
    filled = F.transform("present", lambda s, i: F.concat(gap(number(i - 1), s["no"]), F.array(feature(F.get("types", s["no"]), s["n"], s["days"], s["n"] / F.col("total")))))
    rest = gap(number(F.size("present") - 1), F.size("types"))
    return wide.select("entity", F.coalesce("total", none).alias("n_events"), F.flatten(F.concat(filled, F.array(rest))).alias("features"))
