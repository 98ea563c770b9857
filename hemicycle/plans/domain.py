"""The stored tables as queries use them: repeated rows of a table are one row, deliveries of one vote are one vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemicycle.operators.features import first_deliveries
from hemicycle.schemas import PROPOSALS, USERS, VOTING_BLOCKS
from hemicycle.sources.tables import read_table

#: Columns of proposals but the text, which is as large as all tables together.
PROPOSAL_COLUMNS = tuple(f.name for f in PROPOSALS if f.name != "ProposalTextHTML")


def parties(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "parties", "partyAcronym", "fullName", "logoLink")


def proposals(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "proposals", *(columns or PROPOSAL_COLUMNS)).distinct()


def users(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "users", *(columns or (f.name for f in USERS))).distinct()


def results(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "voting_results", "Id", "isUninamous")


def blocks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "voting_blocks", *(columns or (f.name for f in VOTING_BLOCKS))).distinct()


def votes(spark: SparkSession, d: str) -> DataFrame:
    return first_deliveries(read_table(spark, d, "votes", "Id", "VoteDate", "ProjectLawID", "VotingOrientation", "UserId"), "Id", "VoteDate")


def stats(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "party_stats", "Id", "PoliticalPartypartyAcronym", "PartyAffectionScore", "totalAmountOfProposalsVotedOn", "totalAffectionPoints", "UserId")
