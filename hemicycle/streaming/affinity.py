"""Counters and affinity that follow a stream of votes.

The counters are a streaming aggregation. The clamped fold of affinity is kept as state per user and
party: the steps of a micro-batch fold to a sum and a floor, natively, and compose with the state
(see ``hemicycle.operators.scoring``). A batch writes the rows that it changes under its number, so
one that is run again replaces its own rows only; every so many batches the rows are merged to a
table of all. A query that is started again on the same folder goes on where the last one ended.
Known ids are kept on disk, in RocksDB, so that an executor's memory doesn't bound their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from hemicycle.operators import scoring
from hemicycle.schemas import VOTES
from hemicycle.session import numbered, removed, scratch_dir

_STATE = "UserId int, party string, n_steps bigint, total bigint"
#: Batches after which their rows are merged.
MERGE_EVERY = 16
#: Where a new stream keeps its state; settings given by the caller win.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def vote_stream(spark: SparkSession, folder: str, glob: str = "votes.parquet", files_per_batch: int | None = 1) -> DataFrame:
    """Votes as they are written to a folder of Parquet files; with None for ``files_per_batch``, all files that are there at the start of a batch are one batch."""
    stream = spark.readStream.schema(VOTES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(folder)


def first_arrivals(votes: DataFrame, delay: str | None = None) -> DataFrame:
    """Each vote at its first delivery; with ``delay`` a delivery later than it may count again, and what is known of older votes is dropped, else it is kept for ever."""
    if not delay:
        return votes.dropDuplicates(["Id"])
    return votes.withColumn("at", F.col("VoteDate").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["Id"]).drop("at")


def streaming_counters(votes: DataFrame, delay: str | None = None) -> DataFrame:
    """proposal_id, n_votes, n_interested of the first arrivals."""
    return first_arrivals(votes, delay).groupBy(F.col("ProjectLawID").alias("proposal_id")).agg(F.count("*").alias("n_votes"), F.count_if(F.col("VotingOrientation") != 3).alias("n_interested"))


def _folder(spark: SparkSession, name: str, folder: str | None) -> str:
    return folder.rstrip("/") if folder else f"{scratch_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _run(spark: SparkSession, writer: DataStreamWriter, folder: str) -> None:
    """Run a stream over what is there now, to its end."""
    added = {k: v for k, v in STATE_STORE.items() if spark.conf.get(k, None) is None}
    for k, v in added.items():
        spark.conf.set(k, v)
    try:
        running = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k in added:
            spark.conf.unset(k)
    running.awaitTermination()


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a streaming aggregation over what is there now, and return its result. With ``folder`` the next run goes on from this one."""
    spark = stream.sparkSession
    folder = _folder(spark, name, folder)

    def keep(batch: DataFrame, number: int) -> None:
        older = [n for n in numbered(spark, f"{folder}/result") if n < number]
        batch.write.mode("overwrite").parquet(f"{folder}/result/{number}")
        for n in older:
            removed(spark, f"{folder}/result/{n}")

    _run(spark, stream.writeStream.outputMode("complete").foreachBatch(keep), folder)
    there = numbered(spark, f"{folder}/result")
    return spark.read.parquet(f"{folder}/result/{there[-1]}") if there else spark.createDataFrame([], stream.schema)


def stored_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """UserId, party, n_steps, total after all batches in a folder, or those with numbers below ``before``: per user and party the row with the most steps."""
    known = lambda kind: [n for n in numbered(spark, f"{folder}/{kind}") if before is None or n < before]
    merged = known("merged")[-1:]
    paths = [f"{folder}/merged/{n}" for n in merged] + [f"{folder}/changes/{n}" for n in known("changes") if not merged or n > merged[0]]
    if not paths:
        return spark.createDataFrame([], _STATE).limit(0)  # known to be empty, so that nothing is shuffled to join it
    rows = spark.read.schema(_STATE).parquet(*paths)
    if len(paths) == 1:  # the rows of one batch, or merged ones, are one for each user and party
        return rows
    return rows.groupBy("UserId", "party").agg(F.max("n_steps").alias("n_steps"), F.max_by("total", "n_steps").alias("total"))


def fold_batch(state: DataFrame, steps: DataFrame) -> DataFrame:
    """The rows of the state that the steps (UserId, party, vote_id, block_id, tenths) of one batch change."""
    folded = scoring.stretch(steps, ["UserId", "party"], ["vote_id", "block_id"], "tenths")
    both = folded.join(state.hint("merge"), ["UserId", "party"], "left")  # the state is small as a file, not in memory
    none = F.lit(0).cast("bigint")
    total = scoring.after(F.coalesce("total", none), F.col("sum"), F.col("least"))
    return both.select("UserId", "party", (F.coalesce("n_steps", none) + F.col("n")).alias("n_steps"), total.alias("total"))


def streaming_affinity(votes: DataFrame, steps_of: Callable[[DataFrame], DataFrame], name: str = "affinity", folder: str | None = None, delay: str | None = None, merge_every: int = MERGE_EVERY) -> DataFrame:
    """UserId, party, n_steps, total after all votes of the stream that are there now, in the order of arrival.

    ``steps_of`` makes the steps of a batch of votes. Within a batch the order is that of the vote
    ids; votes that arrive in a later batch than votes with larger ids are folded after them, where
    the batch result would fold them before. Only the first arrival of a vote counts (``delay`` as
    in ``first_arrivals``). With ``folder`` the state is kept there and the next run goes on from
    it; what a batch that is run again would need is kept, older rows are removed.
    """
    spark = votes.sparkSession
    folder = _folder(spark, name, folder)

    def fold(batch: DataFrame, number: int) -> None:
        fold_batch(stored_state(spark, folder, number), steps_of(batch)).write.mode("overwrite").parquet(f"{folder}/changes/{number}")
        if number % merge_every == merge_every - 1:
            last = [n for n in numbered(spark, f"{folder}/merged") if n < number]
            stored_state(spark, folder, number + 1).write.mode("overwrite").parquet(f"{folder}/merged/{number}")
            for kind in ("merged", "changes"):
                for n in numbered(spark, f"{folder}/{kind}"):
                    if last and n < last[-1] + (kind == "changes"):
                        removed(spark, f"{folder}/{kind}/{n}")

    _run(spark, first_arrivals(votes, delay).writeStream.foreachBatch(fold), folder)
    return stored_state(spark, folder)
