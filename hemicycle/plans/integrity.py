"""Queries of the general operators on the stored tables: orphan references, features, shredding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.operators import features, references, shred
from hemicycle.session import spread
from hemicycle.sources.tables import read_table

#: Features are as of this time; votes at it or after it do not count.
AS_OF = "2023-10-01 00:00:00"

PROPOSAL_ROLES = {"": "proposal", "data": "proposal", "proposals": "proposal", "proposingparty": "proposingParty", "votingresultgenerality": "votingResultGenerality", "votingresultspeciality": "votingResultSpeciality", "votingblocks": "votingBlock"}
SESSION_ROLES = {"": "user", "data": "user", "users": "user", "votes": "vote", "partystats": "partyStat", "politicalparty": "politicalParty"}
PROPOSAL_SCALARS = {
    "id": "id", "map_key": shred.MAP_KEY, "acronym": "partyacronym", "full_name": "fullname", "logo_link": "logolink", "source_id": "sourceid", "legislature": "legislatura", "score": "score", "vote_date": "votedate", "title": "proposaltitle", "text_html": "proposaltexthtml", "result": "proposalresult",
    "is_unanimous": "isuninamous", "block_acronym": "politicalpartyacronym", "orientation": "votingorientation", "is_unanimous_within_party": "isuninamouswithinparty", "n_deputies": "numberofdeputies",
}
SESSION_SCALARS = {
    "id": "id", "map_key": shred.MAP_KEY, "acronym": "partyacronym", "full_name": "fullname", "logo_link": "logolink", "user_name": "username", "email": "email", "profile_pic": "profilepic", "google_token": "googleidtoken", "facebook_token": "facebookidtoken",
    "vote_date": "votedate", "proposal_id": "projectlawid", "orientation": "votingorientation", "affection_score": "partyaffectionscore", "n_proposals": "totalamountofproposalsvotedon", "affection_points": "totalaffectionpoints",
}
PROPOSAL_LINKS = [("proposingParty", "proposal"), ("votingResultGenerality", "proposal"), ("votingResultSpeciality", "proposal"), ("votingBlock", "votingResultGenerality"), ("votingBlock", "votingResultSpeciality")]
SESSION_LINKS = [("vote", "user"), ("partyStat", "user"), ("politicalParty", "partyStat")]


def _vote_references(spark: SparkSession, d: str) -> list[references.Reference]:
    return [
        references.Reference("ProjectLawID", read_table(spark, d, "proposals", "Id"), "Id", "proposals", "proposal"),
        references.Reference("UserId", read_table(spark, d, "users", "Id"), "Id", "users", "user"),
    ]


def _vote_orphans(spark: SparkSession, d: str) -> DataFrame:
    votes = read_table(spark, d, "votes", "Id", "VoteDate", "ProjectLawID", "UserId")
    return references.orphan_references(votes, _vote_references(spark, d), read_table(spark, d, "record_log"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Votes whose proposal or user is missing, deleted or recorded only later."""
    return _vote_orphans(spark, d).select(F.col("record_id").alias("vote_id"), "ref_field", "reason")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, calendar month of the vote and reason."""
    return references.orphan_report(_vote_orphans(spark, d), _vote_references(spark, d))


def _vote_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts and last times of the votes that count, by user and type: orientation, acronym and legislature."""
    stored = read_table(spark, d, "votes", "Id", "VoteDate", "ProjectLawID", "VotingOrientation", "UserId")
    votes = stored.where(F.col("VoteDate") < F.lit(AS_OF).cast("timestamp_ntz"))
    counted = features.first_deliveries(votes, "Id", "VoteDate").where(F.col("VotingOrientation").between(0, 3) & F.col("UserId").isNotNull() & F.col("ProjectLawID").isNotNull())
    laws = read_table(spark, d, "proposals", "Id", "ProposingPartypartyAcronym", "Legislatura").groupBy("Id").agg(F.min("ProposingPartypartyAcronym").alias("acronym"), F.min("Legislatura").alias("legislature"))
    hot_laws, hot_users = features.heavy_keys(stored, "ProjectLawID", "UserId")
    typed = features.join_hot(counted, laws.withColumnRenamed("Id", "ProjectLawID"), "ProjectLawID", hot_laws, "Id")
    kind = F.concat_ws(":", F.col("VotingOrientation").cast("string"), "acronym", "legislature")
    users = read_table(spark, d, "users", "Id").withColumnRenamed("Id", "entity")
    return features.event_statistics(typed, "UserId", kind, "VoteDate", "Id", users, hot_users)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Counts and recency for each user and event type with a vote."""
    return _vote_statistics(spark, d).select(F.col("entity").alias("user_id"), "event_type", F.col("n_events").cast("int").alias("n_votes"), features.days_before(F.col("last_at"), AS_OF).alias("days_since_last"))


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per user with the features of all event types: every orientation with every party and legislature of the proposals."""
    stats = _vote_statistics(spark, d)
    pairs = read_table(spark, d, "proposals", "ProposingPartypartyAcronym", "Legislatura").distinct()
    types = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("o"), "*").select(F.concat_ws(":", F.col("o").cast("string"), "ProposingPartypartyAcronym", "Legislatura").alias("event_type"))
    return features.feature_table(stats, read_table(spark, d, "users", "Id"), "Id", types, AS_OF).withColumnRenamed("entity", "user_id")


def features_long(spark: SparkSession, d: str) -> DataFrame:
    """The features of all users and event types as rows."""
    return p3_features(spark, d).select("user_id", F.explode("features").alias("f")).select("user_id", "f.event_type", F.col("f.n_events").alias("n_votes"), "f.days_since_last", "f.share")


#: The scalars that a key may be made of.
KEY_SCALARS = ("id", "map_key", "acronym")


def _entities(spark: SparkSession, d: str, name: str, roles: dict[str, str], scalars: dict[str, str], key_of: dict[str, str]) -> DataFrame:
    records = spread(read_table(spark, d, f"{name}_records", "record_id", "payload"), "record_id")
    nodes = shred.shred(records, "record_id", "payload", frozenset(x for x in roles if x), {*roles, *scalars.values()})
    return shred.entity_tables(nodes, roles, scalars, key_of, f"{name}_entities")


def p5_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals, parties, voting results and blocks of the received records, one row each, with their scalars and their parent's node."""
    return _entities(spark, d, "proposal", PROPOSAL_ROLES, PROPOSAL_SCALARS, {"proposingParty": "acronym"})


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users, votes, party statistics and parties of the received records, one row each, with their scalars and their parent's node."""
    return _entities(spark, d, "session", SESSION_ROLES, SESSION_SCALARS, {"politicalParty": "acronym"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Links between children and parents in the payloads of both record tables; of the scalars only those of keys are shredded."""
    keys = lambda scalars: {k: scalars[k] for k in KEY_SCALARS}
    proposals = _entities(spark, d, "proposal", PROPOSAL_ROLES, keys(PROPOSAL_SCALARS), {"proposingParty": "acronym"})
    sessions = _entities(spark, d, "session", SESSION_ROLES, keys(SESSION_SCALARS), {"politicalParty": "acronym"})
    return shred.links(proposals, PROPOSAL_LINKS).unionByName(shred.links(sessions, SESSION_LINKS))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_features, features_long, p5_found, p5_proposals, p5_sessions)}
