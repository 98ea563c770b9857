"""Score-weighted choice of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one bucket of the prefix sum.
BUCKET = 4096


def running_total(rows: DataFrame, key: str, weight: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with ``running``, the sum of weights up to and with each row in the order of the whole-number ``key``.

    Sums per range of keys come first; only they, one row per ``bucket`` keys, are added up in one task.
    """
    cut = rows.withColumn("_bucket", F.expr(f"`{key}` div {bucket}"))
    sums = cut.groupBy("_bucket").agg(F.sum(weight).alias("_sum"))
    before = sums.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(weight).over(Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_within", within).join(before, F.col("_bucket") == F.col("_of")).withColumn("running", F.col("_before") + F.col("_within")).drop("_bucket", "_of", "_before", "_within")


def weighted_pick(rows: DataFrame, key: str, weight: str, u: float) -> DataFrame:
    """The first row, in the order of ``key``, whose running weight reaches floor(u * total), with 0 <= u < 1.

    A first row of no weight is picked if the draw is 0, others of no weight never. No row gives no row.
    """
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total")).scalar()
    drawn = F.floor(F.lit(u) * total)
    return running_total(rows, key, weight).where(F.col("running") >= drawn).orderBy(key).limit(1)


def weighted_pick_unbiased(rows: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """One row with probability in proportion to its weight: the least exponential key. Rows without weight are never picked."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return rows.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(1)


def last_row(rows: DataFrame, key: str) -> DataFrame:
    """The row of the largest ``key``; no row for an empty table."""
    return rows.where(F.col(key).isNotNull()).orderBy(F.col(key).desc()).limit(1)


def single_or_default(rows: DataFrame) -> DataFrame:
    """The only row, or one row of nulls if there is none; several rows are an error when it is read."""
    whole = F.struct(*rows.columns)
    found = rows.limit(2).agg(F.count("*").alias("n"), F.min(whole).alias("row"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.lit("more than one row")).cast(rows.select(whole.alias("row")).schema["row"].dataType)).otherwise(F.col("row"))
    return found.select(checked.alias("row")).select("row.*")
