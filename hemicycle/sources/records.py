"""Records from and to JSON, literal tables and single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hemicycle.functions.text import enum_code, enum_name, hashed, identifier_kind, stripped_html
from hemicycle.schemas import ORIENTATIONS, PARTIES, PROPOSAL_RESULTS

# The literal table of parties.
SEED_PARTIES = [("UVX", "União do Vale e da Xisteira"), ("FRN", "Frente Renovadora do Norte"), ("MAQ", "Movimento das Aldeias Quietas"), ("PZL", "Partido da Zona Litoral")]

_NULLS = {"ignoreNullFields": "false"}


def seed_parties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, n, f"https://static.example.org/{a.lower()}.png") for a, n in SEED_PARTIES], PARTIES)


def single_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def parsed(rows: DataFrame, payload: str, schema: StructType | str) -> DataFrame:
    """Records of a JSON column as columns; what is no such record gives nulls."""
    return rows.select(F.from_json(payload, schema).alias("r")).select("r.*")


def as_json(rows: DataFrame, name: str = "json", columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON text per row, nulls included."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}).alias(name))


def enveloped(rows: DataFrame, name: str, order: Column | str) -> DataFrame:
    """One row with all rows of a result in one array; for results that a client reads as a whole, never for tables."""
    return rows.select(F.struct(F.struct(order).alias("o"), F.struct(*rows.columns).alias("r")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias(name))


_PARTY = "struct<partyAcronym: string, fullName: string, logoLink: string>"
_RESULT = "struct<id: int, isUninamous: boolean, votingBlocks: array<struct<id: int, isUninamousWithinParty: boolean, numberOfDeputies: int, politicalPartyAcronym: string, votingOrientation: string>>>"
#: Records as services send them.
PROPOSAL_RECORD = f"id int, proposalTitle string, legislatura string, voteDate string, fullProposalTextLink string, proposalTextHTML string, proposalResult string, proposingParty {_PARTY}, votingResultGenerality {_RESULT}, votingResultSpeciality {_RESULT}"
USER_RECORD = f"id int, userName string, email string, password string, profilePic int, googleIDToken string, facebookIDToken string, votes array<struct<id: int, userID: int, projectLawID: int, votingOrientation: string, voteDate: string>>, partyStats array<struct<politicalParty: {_PARTY}, partyAffectionScore: double, totalAmountOfProposalsVotedOn: int, totalAffectionPoints: double>>"


def _client_party(party: Column) -> Column:
    return F.when(party.isNotNull(), F.struct(party["partyAcronym"].alias("partyAcronym"), party["fullName"].alias("partyName"), party["logoLink"].alias("logoUrl")))


def _client_result(result: Column) -> Column:
    def block(b: Column) -> Column:
        return F.struct(
            b["isUninamousWithinParty"].alias("isUnanimousWithinParty"), b["numberOfDeputies"].alias("numberOfDeputados"), b["politicalPartyAcronym"].alias("politicalParty"), enum_code(b["votingOrientation"], ORIENTATIONS).alias("voteOrientation")
        )

    return F.when(result.isNotNull(), F.struct(result["isUninamous"].alias("isUnanimous"), F.transform(result["votingBlocks"], block).alias("votingBlocks")))


def client_proposal(rows: DataFrame) -> DataFrame:
    """Columns as in PROPOSAL_RECORD to the client's record: its names, names of codes as codes, the text as a readable line. What is null stays null."""
    return rows.select(
        F.col("proposalTitle").alias("title"),
        "id",
        "legislatura",
        "voteDate",
        _client_party(F.col("proposingParty")).alias("proposingParty"),
        F.col("fullProposalTextLink").alias("fullTextUrl"),
        stripped_html(F.col("proposalTextHTML")).alias("censoredText"),
        enum_code(F.col("proposalResult"), PROPOSAL_RESULTS).alias("votingResult"),
        _client_result(F.col("votingResultGenerality")).alias("votingResultInGenerality"),
        _client_result(F.col("votingResultSpeciality")).alias("votingResultInSpeciality"),
    )


def client_user(rows: DataFrame) -> DataFrame:
    """Columns as in USER_RECORD to the client's record of a user with votes and statistics; lists that are null are empty."""
    vote = lambda v: F.struct(v["userID"].alias("userID"), v["projectLawID"].alias("proposalID"), enum_code(v["votingOrientation"], ORIENTATIONS).alias("voteOrientation"), v["voteDate"].alias("voteDate"))
    stat = lambda s: F.struct(_client_party(s["politicalParty"]).alias("politicalParty"), s["partyAffectionScore"].alias("partyAffectionScore"), s["totalAmountOfProposalsVotedOn"].alias("totalAmountOfProposalsVotedOn"), s["totalAffectionPoints"].alias("totalAffectionPoints"))
    listed = lambda c, f: F.coalesce(F.transform(c, f), F.array())
    kind = F.when(F.col("googleIDToken").isNotNull(), "google").when(F.col("facebookIDToken").isNotNull(), "facebook").otherwise("email")
    return rows.select(
        F.col("userName").alias("name"),
        F.col("id").alias("userId"),
        "email",
        "password",
        F.col("profilePic").alias("profilePictureId"),
        listed("partyStats", stat).alias("partyStats"),
        listed("votes", vote).alias("userVotes"),
        kind.alias("userType"),
        (F.col("id") != 0).alias("isLoggedIn"),
        F.struct(F.col("id").alias("userID"), F.lit(0).alias("lowestScoreAllowed")).alias("proposalCriteria"),
    )


def vote_json(user: Column, proposal: Column, orientation: Column) -> Column:
    """The JSON of a vote as the client sends it: the code as its name."""
    return F.to_json(F.struct(user.alias("userID"), proposal.alias("projectLawID"), enum_name(orientation, ORIENTATIONS).alias("votingOrientation")), _NULLS)


def login_json(identifier: Column, password: Column) -> Column:
    """The JSON of a login: the identifier as address or name, the password hashed."""
    given = lambda name: F.to_json(F.struct(identifier.alias(name), hashed(password).alias("password")), _NULLS)
    return F.when(identifier_kind(identifier) == "email", given("email")).otherwise(given("userName"))


def party_json(acronym: Column, full_name: Column, logo: Column) -> Column:
    """The JSON of a party under the client's names."""
    return F.to_json(F.struct(acronym.alias("partyAcronym"), full_name.alias("partyName"), logo.alias("logoUrl")), _NULLS)


def block_json(unanimous: Column, deputies: Column, party: Column, orientation: Column) -> Column:
    """The JSON of a block under the client's names."""
    return F.to_json(F.struct(unanimous.alias("isUnanimousWithinParty"), deputies.alias("numberOfDeputados"), party.alias("politicalParty"), enum_name(orientation, ORIENTATIONS).alias("voteOrientation")), _NULLS)


def stats_json(party: Column, score: Column, amount: Column, points: Column) -> Column:
    """The JSON of a party statistic under the client's names; ``party`` is a struct of the stored columns."""
    named = F.struct(party["partyAcronym"].alias("partyAcronym"), party["fullName"].alias("partyName"), party["logoLink"].alias("logoUrl"))
    return F.to_json(F.struct(named.alias("political_party"), score.alias("party_affection_score"), amount.alias("total_amount_of_proposals_voted_on"), points.alias("total_affection_points")), _NULLS)


def criteria_json(user: Column, legislatures: Column, oldest: Column, newest: Column, lowest_score: Column) -> Column:
    """The JSON of criteria as the client sends it; the service reads the legislatures under another name, so that it never filters by them."""
    return F.to_json(F.struct(user.alias("userID"), legislatures.alias("legislaturas"), oldest.alias("oldestVoteDate"), newest.alias("newestVoteDate"), F.coalesce(lowest_score, F.lit(0)).alias("lowestScoreAllowed")), _NULLS)
