"""What a request does to the stored tables: votes that are cast, records that are created.

Requests come as rows, one or many, with their order in ``request``. Each function gives the tables
after the requests and, as ``outcomes``, the message of the first rule that each request breaks (null
for none). The stored tables are joined with the requests' few keys, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions.text import enum_code
from hemicycle.operators import filters, mutations, scoring
from hemicycle.schemas import ORIENTATIONS, PROPOSAL_RESULTS

# Messages that clients show.
NO_PROPOSAL, NO_USER = "No ProjectLaw found with the given id.", "No User found with the given id."
PROPOSAL_EXISTS, NO_SOURCE = "This proposal already exists!", "SourceId is required!"
PARTY_EXISTS = "There is already a Political Party with this name!"
EMAIL_EXISTS, NAME_EXISTS = "An account with this email already exists!", "An account with this username already exists!"
#: Messages of our own.
NO_RESULT, NO_ORIENTATION = "The proposal has no result of the first stage.", "Unknown orientation."


@dataclass(frozen=True)
class Tables:
    """The stored tables that votes touch."""

    votes: DataFrame
    proposals: DataFrame
    users: DataFrame
    stats: DataFrame
    results: DataFrame
    blocks: DataFrame
    parties: DataFrame


def _is_there(requests: DataFrame, key: str, rows: DataFrame, row_key: str, name: str) -> DataFrame:
    """``requests`` with the flag ``name``: whether a row has the key."""
    wanted = requests.select(F.col(key).alias("_wanted")).distinct()
    there = rows.select(F.col(row_key).alias("_there")).join(wanted, F.col("_there") == F.col("_wanted"), "left_semi").distinct()
    return requests.join(there, F.col(key) == F.col("_there"), "left").withColumn(name, F.col("_there").isNotNull()).drop("_there")


def _repeats(requests: DataFrame, key: str, name: str) -> DataFrame:
    """``requests`` with the flag ``name``: whether an earlier request has the same key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("request"))
    return requests.withColumn(name, F.col(key).isNotNull() & (nth > 1))


def cast_votes(tables: Tables, requests: DataFrame, at: Column | None = None) -> dict[str, DataFrame]:
    """votes, proposals, stats and outcomes after votes are cast; requests have request, userID, projectLawID, votingOrientation (a name).

    A request whose orientation, proposal or user does not exist, or whose proposal has no stored
    result of the first stage, changes nothing. ``at`` is the time of the votes, the present by
    default. Every vote counts for its proposal, again if the user voted on it before; the score is
    100 times the whole quotient of interested votes. Every block of the first stage of a known
    party changes the user's statistic of that party, the one of least Id, which is made if there
    is none; points never fall below zero, in the order of requests and block ids.
    """
    when = F.coalesce(at, F.current_timestamp()).cast("timestamp_ntz") if at is not None else F.current_timestamp().cast("timestamp_ntz")
    judged = requests.withColumn("_code", enum_code(F.col("votingOrientation"), ORIENTATIONS))
    laws = tables.proposals.select(F.col("Id").alias("projectLawID"), F.col("VotingResultGeneralityId").alias("_result"), F.col("ProposingPartypartyAcronym").alias("_proposer"))
    laws = laws.join(requests.select("projectLawID").distinct(), "projectLawID", "left_semi").groupBy("projectLawID").agg(F.min("_result").alias("_result"), F.min("_proposer").alias("_proposer"), F.lit(True).alias("_is_law"))
    judged = _is_there(judged.join(laws, "projectLawID", "left"), "userID", tables.users, "Id", "_is_user")
    judged = _is_there(judged, "_result", tables.results, "Id", "_has_result")
    rules = [(NO_ORIENTATION, F.col("_code").isNull()), (NO_PROPOSAL, F.col("_is_law").isNull()), (NO_USER, ~F.col("_is_user")), (NO_RESULT, ~F.col("_has_result"))]
    judged = judged.withColumn("outcome", filters.first_broken_rule(rules))
    good = judged.where("outcome is null")
    new = good.select("request", when.alias("VoteDate"), F.col("projectLawID").alias("ProjectLawID"), F.col("_code").alias("VotingOrientation"), F.col("userID").alias("UserId"))
    votes = mutations.appended(tables.votes, mutations.with_new_ids(new, tables.votes, "Id", "request").drop("request"))

    counted = good.groupBy(F.col("projectLawID").alias("_law")).agg(F.count("*").alias("_votes"), F.count_if(F.col("_code") != 3).alias("_interested"))
    touched = F.col("_law").isNotNull()
    total, interested = F.col("totalAmountOfVotesFromUsers") + F.col("_votes"), F.col("amountOfUsersInterested") + F.col("_interested")
    changes = {"totalAmountOfVotesFromUsers": total, "amountOfUsersInterested": interested, "Score": F.floor(interested / total) * 100}
    joined = tables.proposals.join(counted, F.col("Id") == F.col("_law"), "left")
    proposals = joined.select(*[F.when(touched, changes[c]).otherwise(F.col(c)).cast("int").alias(c) if c in changes else c for c in tables.proposals.columns])

    blocks = tables.blocks.select(F.col("VotingResultId").alias("_result"), F.col("Id").alias("block_id"), F.col("politicalPartyAcronym").alias("party"), F.col("votingOrientation").alias("_block_code"))
    blocks = blocks.join(tables.parties.select(F.col("partyAcronym").alias("party")), "party", "left_semi")
    steps = good.join(blocks, "_result").select(F.col("userID").alias("UserId"), "party", "request", "block_id", scoring.tenths(F.col("party") == F.col("_proposer"), F.col("_block_code") == F.col("_code")).alias("tenths"))
    folded = scoring.stretch(steps, ["UserId", "party"], ["request", "block_id"], "tenths")
    known = tables.stats.select("UserId", F.col("PoliticalPartypartyAcronym").alias("party"), "Id").join(folded.select("UserId", "party"), ["UserId", "party"], "left_semi").groupBy("UserId", "party").agg(F.min("Id").alias("_stat"))
    updates = folded.join(known, ["UserId", "party"], "left")
    own = tables.stats.join(updates.where("_stat is not null").select("_stat", "n", "sum", "least"), F.col("Id") == F.col("_stat"), "left")
    points = scoring.after(F.col("totalAffectionPoints"), F.col("sum") / 10, F.col("least") / 10)
    amount = F.col("totalAmountOfProposalsVotedOn") + F.col("n")
    fresh = {"totalAffectionPoints": points, "totalAmountOfProposalsVotedOn": amount.cast("int"), "PartyAffectionScore": points / amount * 100}
    kept = own.select(*[F.when(F.col("_stat").isNotNull(), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else c for c in tables.stats.columns])
    zero = updates.where("_stat is null").select(F.col("party").alias("PoliticalPartypartyAcronym"), "UserId", "n", (scoring.after(F.lit(0), F.col("sum"), F.col("least")) / 10).alias("totalAffectionPoints"))
    made = zero.withColumn("totalAmountOfProposalsVotedOn", F.col("n").cast("int")).withColumn("PartyAffectionScore", F.col("totalAffectionPoints") / F.col("n") * 100).drop("n")
    stats = mutations.appended(kept, mutations.with_new_ids(made, tables.stats, "Id", "UserId", "PoliticalPartypartyAcronym"))
    return {"votes": votes, "proposals": proposals, "stats": stats, "outcomes": judged.select("request", "outcome")}


def create_proposals(proposals: DataFrame, parties: DataFrame, results: DataFrame, blocks: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """proposals, results, blocks (the new rows alone) and outcomes; requests have request and the fields of ``schemas.PROPOSAL_REQUEST``.

    A link that is taken, by a stored proposal or an earlier request, is tested before the missing
    source. A new proposal has the score 100 and counters of 0, whatever the request says; a party
    that is not known is null. Null results make none.
    """
    judged = _repeats(_is_there(requests, "fullProposalTextLink", proposals, "FullProposalTextLink", "_taken"), "fullProposalTextLink", "_again")
    judged = judged.withColumn("outcome", filters.first_broken_rule([(PROPOSAL_EXISTS, F.col("_taken") | F.col("_again")), (NO_SOURCE, F.col("sourceId").isNull())]))
    good = _is_there(judged.where("outcome is null"), "proposingPartyAcronym", parties, "partyAcronym", "_is_party")
    stages = F.array(*[F.struct(F.lit(i).alias("stage"), F.col(c).alias("result")) for i, c in enumerate(("votingResultGenerality", "votingResultSpeciality"))])
    made = good.select("request", F.explode(stages).alias("s")).select("request", "s.*").where("result is not null")
    made = mutations.with_new_ids(made, results, "Id", "request", "stage")
    parts = mutations.with_new_ids(made.select(F.col("Id").alias("VotingResultId"), F.posexplode("result.votingBlocks").alias("place", "b")), blocks, "Id", "VotingResultId", "place")
    new_blocks = parts.select("Id", "VotingResultId", "b.isUninamousWithinParty", "b.numberOfDeputies", "b.politicalPartyAcronym", enum_code(F.col("b.votingOrientation"), ORIENTATIONS).alias("votingOrientation"))
    of = made.groupBy(F.col("request").alias("_request")).agg(F.max(F.when(F.col("stage") == 0, F.col("Id"))).alias("VotingResultGeneralityId"), F.max(F.when(F.col("stage") == 1, F.col("Id"))).alias("VotingResultSpecialityId"))
    rows = good.join(of, F.col("request") == F.col("_request"), "left").select(
        "request",
        F.col("sourceId").alias("SourceId"),
        F.col("legislatura").alias("Legislatura"),
        F.lit(100).alias("Score"),
        F.lit(0).alias("amountOfUsersInterested"),
        F.lit(0).alias("totalAmountOfVotesFromUsers"),
        F.col("voteDate").alias("VoteDate"),
        F.when(F.col("_is_party"), F.col("proposingPartyAcronym")).alias("ProposingPartypartyAcronym"),
        F.col("proposalTitle").alias("ProposalTitle"),
        F.col("fullProposalTextLink").alias("FullProposalTextLink"),
        F.col("proposalTextHTML").alias("ProposalTextHTML"),
        enum_code(F.col("proposalResult"), PROPOSAL_RESULTS).alias("ProposalResult"),
        "VotingResultGeneralityId",
        "VotingResultSpecialityId",
    )
    return {
        "proposals": mutations.with_new_ids(rows, proposals, "Id", "request").drop("request"),
        "results": made.select("Id", "result.isUninamous"),
        "blocks": new_blocks,
        "outcomes": judged.select("request", "outcome"),
    }


def create_parties(parties: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """parties (the new rows alone) and outcomes; requests have request and the columns of parties. An acronym that is taken, by a stored party or an earlier request, makes none."""
    judged = _repeats(_is_there(requests, "partyAcronym", parties, "partyAcronym", "_taken"), "partyAcronym", "_again")
    judged = judged.withColumn("outcome", filters.first_broken_rule([(PARTY_EXISTS, F.col("_taken") | F.col("_again"))]))
    return {"parties": judged.where("outcome is null").select(*parties.columns), "outcomes": judged.select("request", "outcome")}


def create_users(users: DataFrame, stats: DataFrame, parties: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """users, stats (the new rows alone) and outcomes; requests have request, userName, email, password, profilePic.

    The address is tested before the name, also against earlier requests. A new user has an empty
    statistic for every party.
    """
    judged = _repeats(_is_there(requests, "email", users, "Email", "_email"), "email", "_email_again")
    judged = _repeats(_is_there(judged, "userName", users, "UserName", "_name"), "userName", "_name_again")
    judged = judged.withColumn("outcome", filters.first_broken_rule([(EMAIL_EXISTS, F.col("_email") | F.col("_email_again")), (NAME_EXISTS, F.col("_name") | F.col("_name_again"))]))
    rows = judged.where("outcome is null").select("request", F.col("userName").alias("UserName"), F.col("email").alias("Email"), F.col("password").alias("Password"), F.col("profilePic").alias("ProfilePic"))
    made = mutations.with_new_ids(rows, users, "Id", "request").drop("request")
    # the parties are a table of a fixed, small size: every new user meets each of them
    every = parties.agg(F.array_sort(F.collect_list("partyAcronym")).alias("all")).scalar()
    empty = made.select(F.col("Id").alias("UserId"), F.explode(every).alias("PoliticalPartypartyAcronym")).select(
        "*", F.lit(0.0).alias("PartyAffectionScore"), F.lit(0).alias("totalAmountOfProposalsVotedOn"), F.lit(0.0).alias("totalAffectionPoints")
    )
    return {"users": made, "stats": mutations.with_new_ids(empty, stats, "Id", "UserId", "PoliticalPartypartyAcronym"), "outcomes": judged.select("request", "outcome")}
