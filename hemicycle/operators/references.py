"""References to records that do not exist, by bitmaps.

Keys of integer types are their own dictionary; others are numbered by one (``dictionary``), which
holds every key that a field, a parent or the log names. The keys that a field names in one period are kept as bitmaps of 64 keys each:
one row per field, period and key range (``key >> 6``) with the bits of the keys seen. Ranges
without a bit have no row, which compresses sparse key spaces. The parents have one bitmap row per
range, too: bits of the keys that exist, bits of the keys that were removed, and the times of
creation of the at most 64 keys of the range. One join per range computes ``reference AND NOT
parent``; only the surviving bits are decoded to keys and looked up among the records. The surviving
bitmaps are written once; where they are few, they go to all tasks, and only the references that hit
them are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hemicycle.operators.features import heavy_keys, join_hot
from hemicycle.session import materialise

#: Buckets within which the dictionary numbers keys.
BUCKETS = 4096
#: Surviving bitmaps that are broadcast to the references, so that only hits are shuffled; where more survive, all references are.
BROADCAST_RANGES = 200_000
#: Keys of one bitmap: the bits of a bigint.
RANGE_BITS = 6
#: Period of records without time.
NO_PERIOD = -1


@dataclass(frozen=True)
class Reference:
    """A field of the records, the table and column it refers to, and the entity's name in the log."""

    field: str
    parent: DataFrame
    parent_key: str
    parent_name: str
    entity: str


def month_number(time: Column) -> Column:
    """Months since year 0; NO_PERIOD for null."""
    return F.coalesce(F.year(time) * 12 + F.month(time) - 1, F.lit(NO_PERIOD))


def _range(key: Column) -> Column:
    return F.shiftright(key, RANGE_BITS)


def _position(key: Column) -> Column:
    return key.bitwiseAND(F.lit(63)).cast("int")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def dictionary(keys: DataFrame) -> DataFrame:
    """key, code: the distinct texts of the column ``key`` with integers that no two share, numbered within buckets of a hash, so that no task sees all keys."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS).cast("bigint"))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("key")).cast("bigint")
    return keys.where("key is not null").distinct().withColumn("_bucket", bucket).select("key", ((nth - 1) * BUCKETS + F.col("_bucket")).alias("code"))


def _references(records: DataFrame, references: list[Reference], record_id: str, time: str, key_type: str) -> DataFrame:
    """One row per record and non-null reference: record, at, ref_field, period, key."""
    named = F.array(*[F.struct(F.lit(r.field).alias("ref_field"), F.col(r.field).cast(key_type).alias("key")) for r in references])
    return (
        records.select(F.col(record_id).alias("record"), F.col(time).alias("at"), F.explode(named).alias("named"))
        .select("record", "at", "named.ref_field", month_number(F.col("at")).alias("period"), "named.key")
        .where(F.col("key").isNotNull())
    )


def _facts(references: list[Reference], log: DataFrame, key_type: str) -> DataFrame:
    """What tables and log say of parents: ref_field, key, present, removed, created."""
    facts = None
    for r in references:
        label = F.lit(r.field).alias("ref_field")
        there = r.parent.select(label, F.col(r.parent_key).cast(key_type).alias("key"), F.lit(1).alias("present"), F.lit(0).alias("removed"), F.lit(None).cast("timestamp_ntz").alias("created"))
        told = log.where((F.col("entity") == r.entity) & F.col("operation").isin("created", "removed")).select(
            label,
            F.col("entity_id").cast(key_type).alias("key"),
            F.lit(0).alias("present"),
            (F.col("operation") == "removed").cast("int").alias("removed"),
            F.when(F.col("operation") == "created", F.col("logged_at").cast("timestamp_ntz")).alias("created"),
        )
        both = there.unionAll(told)
        facts = both if facts is None else facts.unionAll(both)
    return facts.where(F.col("key").isNotNull())


def _parents(facts: DataFrame) -> DataFrame:
    """One row per field and key range with what is known of its parents."""
    keys = facts.groupBy("ref_field", "key").agg(F.max("present").alias("present"), F.max("removed").alias("removed"), F.min("created").alias("created"))
    bit = _bit(_position(F.col("key")))
    none = F.lit(0).cast("bigint")
    return (
        keys.groupBy("ref_field", _range(F.col("key")).alias("range"))
        .agg(
            F.bit_or(F.when(F.col("present") == 1, bit).otherwise(none)).alias("there"),
            F.bit_or(F.when(F.col("removed") == 1, bit).otherwise(none)).alias("gone"),
            F.collect_list(F.when(F.col("created").isNotNull(), F.struct(month_number(F.col("created")).alias("month"), _position(F.col("key")).alias("position"), F.col("created")))).alias("made"),
        )
        .withColumnRenamed("ref_field", "parent_field")
        .withColumnRenamed("range", "parent_range")
    )


def _decoded(bits: Column, key_range: Column) -> Column:
    """The keys of the bits that are set."""
    positions = F.sequence(F.lit(0), F.lit(63))
    is_set = lambda i: F.call_function("shiftrightunsigned", bits, i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    base = F.call_function("shiftleft", key_range, F.lit(RANGE_BITS))
    return F.transform(F.filter(positions, is_set), lambda i: base + i)


def survivors(named: DataFrame, parents: DataFrame) -> DataFrame:
    """What is left of the references' bitmaps after ``reference AND NOT parent``: ref_field, period, range, missing, gone (bits) and late (positions and times); ranges of which nothing is left have no row.

    ``late`` keys exist, but were created in the period of the reference or after it; whether a
    single reference was too early is left to the comparison of times.
    """
    refs = named.groupBy("ref_field", "period", _range(F.col("key")).alias("range")).agg(F.bit_or(_bit(_position(F.col("key")))).alias("bits"))
    joined = refs.join(parents, (F.col("ref_field") == F.col("parent_field")) & (F.col("range") == F.col("parent_range")), "left")
    bits, none = F.col("bits"), F.lit(0).cast("bigint")
    there, gone = F.coalesce(F.col("there"), none), F.coalesce(F.col("gone"), none)
    orphan, known = bits.bitwiseAND(F.bitwise_not(there)), bits.bitwiseAND(there)
    late = F.filter(F.coalesce(F.col("made"), F.array().cast("array<struct<month:int,position:int,created:timestamp_ntz>>")), lambda m: (m["month"] >= F.col("period")) & (_bit(m["position"]).bitwiseAND(known) != 0))
    left = joined.select("ref_field", "period", "range", orphan.bitwiseAND(F.bitwise_not(gone)).alias("missing"), orphan.bitwiseAND(gone).alias("gone"), late.alias("late"))
    return left.where("missing <> 0 or gone <> 0 or size(late) > 0")


def suspects(left: DataFrame) -> DataFrame:
    """The keys of surviving bits, decoded: ref_field, period, key, reason, created."""
    never = F.lit(None).cast("timestamp_ntz")
    of = lambda reason, keys: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(reason).alias("reason"), never.alias("created")))
    base = F.call_function("shiftleft", F.col("range"), F.lit(RANGE_BITS))
    late = F.transform("late", lambda m: F.struct((base + m["position"]).alias("key"), F.lit("late").alias("reason"), m["created"].alias("created")))
    found = F.concat(of("missing", _decoded(F.col("missing"), F.col("range"))), of("deleted", _decoded(F.col("gone"), F.col("range"))), late)
    return left.select("ref_field", "period", F.explode(found).alias("found")).select("ref_field", "period", "found.*")


def among(named: DataFrame, left: DataFrame) -> DataFrame:
    """The references whose bit survived, by a broadcast of the surviving bitmaps."""
    any_late = F.aggregate("late", F.lit(0).cast("bigint"), lambda bits, m: bits.bitwiseOR(_bit(m["position"])))
    wanted = left.select(F.col("ref_field").alias("_field"), F.col("period").alias("_period"), "range", F.col("missing").bitwiseOR(F.col("gone")).bitwiseOR(any_late).alias("_bits"))
    same = (F.col("ref_field") == F.col("_field")) & (F.col("period") == F.col("_period")) & (_range(F.col("key")) == F.col("range"))
    return named.join(F.broadcast(wanted), same).where(_bit(_position(F.col("key"))).bitwiseAND(F.col("_bits")) != 0).select(*named.columns)


def orphan_references(records: DataFrame, references: list[Reference], log: DataFrame, record_id: str = "Id", time: str = "VoteDate", salts: int = 8) -> DataFrame:
    """Every record and field whose reference is an orphan: record_id, ref_field, key, reason, at.

    ``deleted``: no row of the parent has the key and the log holds its removal; ``missing``: no row
    and no removal; ``late``: a row, but its earliest ``created`` entry is later than the record.
    Rows with one ``record_id`` are one record, dated by its earliest time; rows without
    ``record_id`` count as one record. Null references are none; a record without time is never
    late; a parent without ``created`` entry is never late; empty inputs give no row. ``log`` has
    entity, entity_id, operation, logged_at; other operations and other columns are ignored.
    ``salts`` spreads the records of one hot key over so many tasks. Where a field, a parent's key or
    the log's entity_id is not of an integer type, all keys are compared as texts, numbered by a dictionary.
    """
    types = [*(records.schema[r.field] for r in references), *(r.parent.schema[r.parent_key] for r in references), log.schema["entity_id"]]
    integers = all(isinstance(t.dataType, IntegralType) for t in types)
    key_type = "bigint" if integers else "string"
    named, facts = _references(records, references, record_id, time, key_type), _facts(references, log, key_type)
    if not integers:
        codes = materialise(dictionary(named.select("key").unionByName(facts.select("key"))), "key_dictionary")
        coded = lambda rows, hot, spread: join_hot(rows, codes, "key", hot, spread).drop("key").withColumnRenamed("code", "key")
        named, facts = coded(named, *heavy_keys(named, "key"), "record"), coded(facts, [], "ref_field")
    left = materialise(survivors(named, _parents(facts)), "orphan_ranges")
    keys = suspects(left).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if left.count() <= BROADCAST_RANGES:
        named = among(named, left)
    hit = named.withColumn("salt", F.pmod(F.hash("record", "at"), F.lit(salts))).join(keys, ["ref_field", "period", "key", "salt"])
    found = (
        hit.groupBy("record", "ref_field", "key")
        .agg(F.min("at").alias("at"), F.min("reason").alias("reason"), F.min("created").alias("created"))
        .where((F.col("reason") != "late") | (F.col("created") > F.col("at")))
    )
    if not integers:
        found = found.withColumnRenamed("key", "code").join(codes, "code")
    return found.select(F.col("record").alias("record_id"), "ref_field", "key", "reason", "at")


def orphan_report(orphans: DataFrame, references: list[Reference]) -> DataFrame:
    """Orphans per table referred to, calendar month and reason: table_name, month (``yyyy-MM``, null without time), reason, n_references, n_keys."""
    names = F.create_map(*[F.lit(x) for r in references for x in (r.field, r.parent_name)])
    month = F.when(F.col("at").isNotNull(), F.format_string("%04d-%02d", F.year("at"), F.month("at")))
    return orphans.groupBy(names[F.col("ref_field")].alias("table_name"), month.alias("month"), "reason").agg(F.count("*").alias("n_references"), F.countDistinct("key").alias("n_keys"))
