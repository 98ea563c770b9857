"""Mixing sources to target weights.

Weighted sampling without replacement after Efraimidis and Spirakis: every document draws an
exponential key whose rate is its quality weight, and a source is taken in the order of its keys. A
source is used in whole epochs as often as its target holds all of it; the rest of the target is the
prefix of the order whose tokens fit. Prefix sums are taken within buckets of the key and shifted by
the sums of the buckets before, so that a source of any size spreads over tasks.

Buckets are equal steps of the key's logarithm. The logarithm of an exponential variable has a
density of at most 1/e, whatever its rate, and so has any mixture of them: a step of s holds at most
s/e of a source, whatever the weights. The step follows from the number of documents of the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions.keys import trimmed_lower
from hemicycle.session import materialise

#: Targets that are broadcast; more are joined by a shuffle.
BROADCAST_TARGETS = 10_000
#: Documents of one bucket at most, as expected.
BUCKET_ROWS = 100_000


def exponential_key(key: str, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of key and seed, so that a task that runs again draws the same."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_sizes(documents: DataFrame) -> DataFrame:
    """source_key, available_tokens, available_documents; one row per source, that of null included. Written once, since every later step reads it."""
    return materialise(documents.groupBy("source_key").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("available_documents")), "source_sizes")


def target_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The distinct rows of ``targets`` with source_key, target_share, target_tokens, available_tokens, available_documents, repeats, epochs and budget.

    A mix has ``size_factor`` times the tokens of all documents, those without source included. A
    source's share is its weight over the sum of the mix; null or negative weights count as 0.
    ``repeats`` is max_repeats, 1 for null. Of the target, ``epochs`` are complete uses of the
    source and ``budget`` the tokens that remain.
    """
    total = sizes.agg(F.coalesce(F.sum("available_tokens"), F.lit(0)).alias("total")).scalar()
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    rows = targets.select("mix_id", "size_factor", "source", "target_weight", "max_repeats").distinct().withColumn("source_key", trimmed_lower(F.col("source"))).withColumn("_weight", weight)
    sums = rows.groupBy("mix_id").agg(F.sum("_weight").alias("_sum")).withColumnRenamed("mix_id", "_mix")
    known = rows.join(sums, F.col("mix_id").eqNullSafe(F.col("_mix"))).join(sizes.where("source_key is not null"), "source_key", "left")
    share = F.when(F.col("_sum") > 0, F.col("_weight") / F.col("_sum")).otherwise(0.0)
    planned = (
        known.withColumn("target_share", share)
        .withColumn("target_tokens", F.coalesce(F.col("target_share") * F.col("size_factor") * total, F.lit(0.0)))
        .withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
        .withColumn("available_documents", F.coalesce("available_documents", F.lit(0)))
        .withColumn("repeats", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)))
    )
    whole = F.when(F.col("available_tokens") > 0, F.least(F.floor(F.col("target_tokens") / F.col("available_tokens")), F.col("repeats").cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    rest = F.when(F.col("epochs") < F.col("repeats"), F.col("target_tokens") - F.col("epochs") * F.col("available_tokens")).otherwise(0.0)
    return planned.withColumn("epochs", whole).withColumn("budget", rest).drop("_mix", "_sum", "_weight")


def bucket_of(exponential: Column, documents: Column, bucket_rows: int) -> Column:
    """The step of a key's logarithm, in a source of so many documents; steps are so small that ``bucket_rows`` documents are expected in one at most."""
    step = F.least(F.lit(1.0), math.e * bucket_rows / documents)
    return F.floor(F.log(exponential) / step)


def running_tokens(documents: DataFrame, sizes: DataFrame, key: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Documents that have a source, with the tokens of their source up to and with them in the order of their keys."""
    steps = sizes.where("source_key is not null").select("source_key", "available_documents")
    keyed = documents.where("source_key is not null").join(F.broadcast(steps) if steps.count() <= BROADCAST_TARGETS else steps, "source_key").withColumn("_key", exponential_key(key, F.col("weight"), seed))
    keyed = keyed.withColumn("_bucket", bucket_of(F.col("_key"), F.col("available_documents"), bucket_rows))
    sums = keyed.groupBy("source_key", "_bucket").agg(F.sum("n_tokens").alias("_tokens"))
    earlier = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source_key", "_bucket", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source_key", "_bucket").orderBy("_key", key).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("_within", F.sum("n_tokens").over(within)).join(before, ["source_key", "_bucket"]).withColumn("running", F.col("_before") + F.col("_within")).select(key, "source_key", "n_tokens", "running")


def mix(documents: DataFrame, targets: DataFrame, key: str, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_id, source, key, n_tokens, n_uses) and the plan of its targets.

    ``documents`` has ``key`` (unique, not null), source (sources that differ in letter case or
    surrounding white space are the same; null is none), n_tokens, and weight > 0; they are read
    several times and ought to be stored. ``targets`` has mix_id, size_factor, source, target_weight,
    max_repeats. A document is in the last, partial epoch if more than half of it fits the budget,
    which misses the target by half a document at most. All mixes share the order of a source.
    """
    known = documents.select(key, trimmed_lower(F.col("source")).alias("source_key"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "weight")
    sizes = source_sizes(known)
    plan = materialise(target_plan(sizes, targets), "mix_plan")
    wanted = plan.where("epochs > 0 or budget > 0").select("mix_id", "source", "source_key", "epochs", "budget")
    if plan.count() <= BROADCAST_TARGETS:
        wanted = F.broadcast(wanted)
    uses = F.col("epochs") + (F.col("running") - F.col("n_tokens") / 2 < F.col("budget")).cast("int")
    chosen = running_tokens(known, sizes, key, seed, bucket_rows).join(wanted, "source_key").withColumn("n_uses", uses.cast("int")).where("n_uses > 0")
    return chosen.select("mix_id", "source", key, "n_tokens", "n_uses"), plan


def mix_report(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Targets and what was reached: mix_id, source, target_share, actual_share, target_tokens, reached_tokens, n_documents, least_uses, most_uses, reachable.

    ``reachable`` is read off the selection: it is false where every document of the source was used
    as often as it may be and the tokens still fall short of the target; a source without documents,
    or one that may not be used, has nothing left, either.
    """
    taken = selection.groupBy(F.col("mix_id").alias("_mix"), F.col("source").alias("_source")).agg(
        F.sum(F.col("n_tokens") * F.col("n_uses")).alias("reached_tokens"), F.count("*").alias("n_documents"), F.min("n_uses").alias("least_uses"), F.max("n_uses").alias("most_uses")
    )
    joined = plan.join(taken, F.col("mix_id").eqNullSafe(F.col("_mix")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    filled = joined.select(*plan.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reached_tokens", "n_documents", "least_uses", "most_uses")])
    exhausted = (F.col("n_documents") == F.col("available_documents")) & (F.col("least_uses") >= F.col("repeats")) | (F.col("available_tokens") * F.col("repeats") == 0)
    all_of = F.sum("reached_tokens").over(Window.partitionBy("mix_id"))
    share = F.when(all_of > 0, F.col("reached_tokens") / all_of).otherwise(0.0)
    return filled.select("mix_id", "source", "target_share", share.alias("actual_share"), "target_tokens", "reached_tokens", "n_documents", "least_uses", "most_uses", (~(exhausted & (F.col("reached_tokens") < F.col("target_tokens")))).alias("reachable"))
