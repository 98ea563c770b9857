"""Changes of tables as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null values of the patch row of the same key; keys of the patch without row change nothing. ``patch`` has one row per key."""
    changed = [c for c in patch.columns if c != key and c in rows.columns]
    new = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    return rows.join(new, F.col(key) == F.col("_key"), "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else c for c in rows.columns])


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; columns that one lacks are null."""
    return rows.unionByName(new, allowMissingColumns=True)


def with_new_ids(new: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``new`` with ``key`` numbered on from the largest of ``rows`` in the order of columns; meant for a request's few rows."""
    last = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("last")).scalar()
    return new.withColumn(key, (F.row_number().over(Window.orderBy(*order)) + last).cast(rows.schema[key].dataType))


def accepted(new: DataFrame, rows: DataFrame, *unique: str) -> DataFrame:
    """The new rows whose value is not taken in any of the ``unique`` columns; nulls are never taken."""
    for c in unique:
        new = new.join(rows.select(F.col(c).alias("_taken")), F.col(c) == F.col("_taken"), "left_anti")
    return new


def rejected(new: DataFrame, rows: DataFrame, *unique: str) -> DataFrame:
    """The new rows that ``accepted`` leaves out, with ``conflict``: the first of the ``unique`` columns that is taken."""
    out = None
    for c in unique:
        hit = new.join(rows.select(F.col(c).alias("_taken")), F.col(c) == F.col("_taken"), "left_semi").withColumn("conflict", F.lit(c))
        out = hit if out is None else out.unionByName(hit)
        new = accepted(new, rows, c)
    return out


def get_or_create(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted keys, and a new row for those that have none."""
    there = rows.join(wanted.select(F.col(key).alias("_wanted")), F.col(key) == F.col("_wanted"), "left_semi")
    return appended(there, accepted(wanted, rows, key))


def deleted(rows: DataFrame, column: str, *values) -> DataFrame:
    """Without the rows whose column is one of the values; nulls stay."""
    return rows.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def detached(rows: DataFrame, column: str, *values) -> DataFrame:
    """With null where the column is one of the values."""
    return rows.withColumn(column, F.when(~F.col(column).isin(*values), F.col(column)))


def emptied(rows: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return rows.where(F.lit(False))


def migrated(rows: DataFrame, renamed: Mapping[str, str], added: Mapping[str, Column], dropped: Sequence[str] = (), retyped: Mapping[str, str] | None = None) -> DataFrame:
    """The table in a new shape: columns dropped, then cast to new types, then renamed, then added. A value that the new type cannot hold is an error in ANSI mode, else null."""
    cast = {c: F.col(c).cast(t) for c, t in (retyped or {}).items()}
    return rows.drop(*dropped).withColumns(cast).withColumnsRenamed(dict(renamed)).withColumns(dict(added))


def reseeded(rows: DataFrame, key: str, inserted: DataFrame | None = None, patch: DataFrame | None = None, removed: Sequence = ()) -> DataFrame:
    """The rows after a change of seed data: keys removed, values of the patch set, rows inserted whose key is not there."""
    out = deleted(rows, key, *removed) if removed else rows
    out = patched(out, patch, key) if patch is not None else out
    return appended(out, accepted(inserted, out, key)) if inserted is not None else out
