"""Counters of votes, and affinity between users and parties: a sum that is clamped at zero after each step.

The clamped fold depends on the order, but folds of consecutive stretches compose: a stretch with sum
S and floor T maps a value x to max(x + S, T), where T is S less the least prefix sum. A group is
therefore cut into stretches of the order, folded in parallel, and the stretches are composed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vote ids of one stretch.
STRETCH = 1 << 16


def vote_counters(votes: DataFrame, proposal: str, orientation: str, indifferent: int = 3) -> DataFrame:
    """proposal, n_votes, n_interested, score: of all votes, of those that are not indifferent, and 100 times their whole quotient. Votes without proposal are left out; a null orientation counts as interest in nothing."""
    counted = votes.where(F.col(proposal).isNotNull()).groupBy(F.col(proposal).alias("proposal_id")).agg(F.count("*").alias("n_votes"), F.count_if(F.col(orientation) != indifferent).alias("n_interested"))
    return counted.withColumn("score", F.expr("(n_interested div n_votes) * 100"))


def tenths(is_proposer: Column, agrees: Column) -> Column:
    """Points of one block in tenths."""
    return F.when(is_proposer, F.when(agrees, 10).otherwise(-2)).otherwise(F.when(agrees, 9).otherwise(-1))


def clamped_fold(steps: DataFrame, group: list[str], order: list[str], value: str, stretch: int = STRETCH) -> DataFrame:
    """group, n_steps, total: the values of each group added in ``order``, the sum set to zero whenever it is negative.

    The first column of ``order`` is a whole number; its ranges of ``stretch`` are folded in
    parallel. Rows that tie in all of ``order`` are added from the least value up. Null values add nothing.
    """
    cut = steps.withColumn("_stretch", F.expr(f"`{order[0]}` div {stretch}")).withColumn("_value", F.coalesce(F.col(value), F.lit(0)).cast("bigint"))
    prefix = F.sum("_value").over(Window.partitionBy(*group, "_stretch").orderBy(*order, "_value").rowsBetween(Window.unboundedPreceding, 0))
    folded = cut.withColumn("_prefix", prefix).groupBy(*group, "_stretch").agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"), F.min("_prefix").alias("_least"))
    so_far = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0))
    lowest = folded.withColumn("_low", so_far - F.col("_sum") + F.col("_least"))
    return lowest.groupBy(*group).agg(F.sum("_n").alias("n_steps"), (F.sum("_sum") - F.least(F.lit(0), F.min("_low"))).alias("total"))


def stretch(steps: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """group, n, sum, least: number and sum of the values of each group, and the least of its prefix sums in the order; what a clamped fold of the group does to any total before it (see ``after``)."""
    prefix = F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("_prefix", prefix).groupBy(*group).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.min("_prefix").alias("least"))


def after(total: Column, added: Column, least: Column) -> Column:
    """The total after a stretch with the sum ``added`` and the least prefix sum ``least``."""
    return F.greatest(total + added, added - least)


def folded_in_array(steps: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The same as ``clamped_fold`` as an aggregate over each group's sorted array, for groups of moderate size."""
    taken = F.struct(*order, F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias("_value"))
    gathered = steps.groupBy(*group).agg(F.array_sort(F.collect_list(taken)).alias("_steps"))
    return gathered.select(*group, F.size("_steps").cast("bigint").alias("n_steps"), F.aggregate("_steps", F.lit(0).cast("bigint"), lambda total, s: F.greatest(total + s["_value"], F.lit(0).cast("bigint"))).alias("total"))
