"""Optional predicates: a parameter that is absent does not filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.functions.text import contains_ignoring_case


def by_criteria(proposals: DataFrame, legislatures: Sequence[str] | None = None, oldest: str | None = None, newest: str | None = None, lowest_score: int = 0) -> DataFrame:
    """Proposals of some legislatures, with vote dates within inclusive bounds and at least a score.

    None skips a predicate; an empty list of legislatures matches nothing. Dates are compared as
    texts, as they are stored. Rows whose tested column is null do not match.
    """
    out = proposals.where(F.col("Score") >= lowest_score)
    if legislatures is not None:
        out = out.where(F.col("Legislatura").isin(list(legislatures)))
    if oldest is not None:
        out = out.where(F.col("VoteDate") >= oldest)
    if newest is not None:
        out = out.where(F.col("VoteDate") <= newest)
    return out


def search(rows: DataFrame, needle: str | None, *columns: str) -> DataFrame:
    """Rows with ``needle`` in any of the columns, numbers read as texts; all rows for None or an empty needle. Blanks do filter."""
    if not needle:
        return rows
    found: Column = F.lit(False)
    for c in columns:
        text = F.col(c) if dict(rows.dtypes)[c] == "string" else F.col(c).cast("string")
        found = found | contains_ignoring_case(text, needle)
    return rows.where(found)


def invalid_codes(rows: DataFrame, column: str, codes: Sequence[int]) -> DataFrame:
    """Rows whose code is null or not among ``codes``."""
    return rows.where(~F.coalesce(F.col(column).isin(list(codes)), F.lit(False)))


def missing_values(rows: DataFrame, *required: str) -> DataFrame:
    """One row per required column: column_name, n_missing."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in required])).alias("r")).select("r.*")


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def first_broken_rule(rules: Sequence[tuple[str, Column]]) -> Column:
    """The message of the first rule whose condition holds, null for none; a null condition does not hold."""
    out = F.lit(None).cast("string")
    for message, broken in reversed(rules):
        out = F.when(broken, message).otherwise(out)
    return out
