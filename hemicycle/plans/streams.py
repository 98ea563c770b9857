"""Streaming queries on the stored votes, run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemicycle.plans import catalogue
from hemicycle.streaming import affinity


def _folder(spark: SparkSession, d: str) -> DataFrame:
    """The stream of the file votes.parquet, or of the files in the folder of that name. What is stored is one batch: its files overlap in vote ids, and a batch per file would cost more than its votes."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{d}/votes.parquet")
    is_folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return affinity.vote_stream(spark, f"{d}/votes.parquet" if is_folder else d, "*.parquet" if is_folder else "votes.parquet", None)


def vote_counters_streaming(spark: SparkSession, d: str) -> DataFrame:
    return affinity.run_available(affinity.streaming_counters(_folder(spark, d).drop("UserId", "VoteDate")), "counters")


def affinity_streaming(spark: SparkSession, d: str) -> DataFrame:
    return affinity.streaming_affinity(_folder(spark, d).drop("VoteDate"), lambda votes: catalogue.affinity_steps_by_user(spark, d, votes))


def queries() -> dict:
    return {f.__name__: f for f in (vote_counters_streaming, affinity_streaming)}


SQL = {
    "vote_counters_streaming": "select ProjectLawID as proposal_id, count(*) as n_votes, sum(case when VotingOrientation <> 3 then 1 else 0 end)::bigint as n_interested from (select Id, min(ProjectLawID) as ProjectLawID, min(VotingOrientation) as VotingOrientation from votes group by Id) group by 1",
    # the stored votes are one batch: the order of arrival is that of the vote ids
    "affinity_streaming": f"select UserId, party, n_steps, round(points * 10)::bigint as total from ({catalogue.SQL['party_affinity']}) t",
}
