"""Lookups of one parent, and children as arrays.

Children are aggregated before they meet their parents, so that sibling collections never multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_parent(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str, how: str = "left") -> DataFrame:
    """``rows`` with the parent as a struct column ``name``; null where there is none, or no row with ``how="inner"``.

    Parent rows without key are no parents; of several rows with one key the least in column order is the parent.
    """
    one = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("_parent_key")).agg(F.min(F.struct(*parents.columns)).alias(name))
    return rows.join(one, F.col(key) == F.col("_parent_key"), how).drop("_parent_key")


def with_children(rows: DataFrame, key: str, children: DataFrame, child_key: str, name: str) -> DataFrame:
    """``rows`` with their children as an array of structs in column order; an empty array where there are none. Children without key belong to nobody."""
    fields = [c for c in children.columns if c != child_key]
    nested = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_child_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return rows.join(nested, F.col(key) == F.col("_child_key"), "left").drop("_child_key").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def without(rows: DataFrame, key: str, seen: DataFrame, seen_key: str) -> DataFrame:
    """Rows whose key is not among the seen ones; null keys stay."""
    return rows.join(seen.select(F.col(seen_key).alias("_seen")), F.col(key) == F.col("_seen"), "left_anti")


def for_each(rows: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """Every row with every row of a small table, given as a scalar array: the table must be one whose size is fixed."""
    everything = other.select(F.struct(*columns).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("all")).scalar()
    return rows.select("*", F.explode(everything).alias("_each")).select(*rows.columns, *[F.col(f"_each.{c}").alias(c) for c in columns])


def by_first_key(rows: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with the row of ``others`` that has the same value in the first of ``keys`` that is not null in ``rows``; null where there is none, or no key."""
    given = F.coalesce(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))) for k in keys])
    known = others.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("_known")).where("_known.value is not null")
    one = known.groupBy(F.col("_known").alias("_at")).agg(F.min(F.struct(*others.columns)).alias(name))
    return rows.withColumn("_given", given).join(one, F.col("_given") == F.col("_at"), "left").drop("_given", "_at")
