"""Queries of whole requests, nested rows and records in and out, each with its SQL; they join the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.functions import text
from hemicycle.operators import filters, mutations, nesting, picking, requests
from hemicycle.plans import domain
from hemicycle.plans.catalogue import query
from hemicycle.schemas import CRITERIA, ORIENTATIONS, PROPOSAL_REQUEST, PROPOSAL_RESULTS, VOTE_REQUEST
from hemicycle.sources import records

# Choice of the next proposal

_REQUEST = '{"userID": 7, "legislatura": ["XIII", "XIV", "XV"], "oldestVoteDate": "2015-01-01", "newestVoteDate": "2022-12-31", "lowestScoreAllowed": 0}'
_WANTED = "Legislatura in ('XIII', 'XIV', 'XV') and VoteDate >= '2015-01-01' and VoteDate <= '2022-12-31' and Score >= 0"
_SEEN = "(select ProjectLawID from ballots where UserId = 7 and ProjectLawID is not null)"


def _criteria(spark: SparkSession, body: str) -> tuple[int, dict]:
    """The user and the criteria of one request."""
    r = records.parsed(spark.createDataFrame([(body,)], "body string"), "body", CRITERIA).first()
    return r.userID, {"legislatures": r.legislatura, "oldest": r.oldestVoteDate, "newest": r.newestVoteDate, "lowest_score": r.lowestScoreAllowed or 0}


def _open_proposals(spark: SparkSession, d: str, body: str) -> DataFrame:
    """Proposals that meet a request's criteria and on which its user has not voted."""
    user, criteria = _criteria(spark, body)
    met = filters.by_criteria(domain.proposals(spark, d, "Id", "Legislatura", "VoteDate", "Score"), **criteria)
    return nesting.without(met, "Id", domain.votes(spark, d).where((F.col("UserId") == user) & F.col("ProjectLawID").isNotNull()).select("ProjectLawID"), "ProjectLawID")


@query(f", open as (select Id, Score, (sum(Score) over (order by Id rows unbounded preceding))::bigint as running from laws where {_WANTED} and Id not in {_SEEN}) select Id, Score, running from open where running >= (select floor(0.61 * sum(Score)) from open) order by Id limit 1")
def weighted_pick_for_user(spark, d):
    """Criteria, without what the user has voted on, then the weighted choice."""
    return picking.weighted_pick(_open_proposals(spark, d, _REQUEST), "Id", "Score", 0.61).select("Id", "Score", "running")


@query("select Id, Score, 0::bigint as running from laws where false")
def weighted_pick_all_voted(spark, d):
    """A user who has voted on every proposal that is left gets none."""
    seen = domain.votes(spark, d).where("UserId = 7").select("ProjectLawID").distinct()
    voted = domain.proposals(spark, d, "Id", "Score").join(seen, F.col("Id") == F.col("ProjectLawID"), "left_semi")
    return picking.weighted_pick(nesting.without(voted, "Id", seen, "ProjectLawID"), "Id", "Score", 0.61).select("Id", "Score", "running")


@query("select Id, Score from laws where Id = (select max(Id) from laws)")
def last_proposal(spark, d):
    return picking.last_row(domain.proposals(spark, d, "Id", "Score"), "Id")


@query("select partyAcronym, fullName from parties where partyAcronym = 'UVX'")
def single_party(spark, d):
    return picking.single_or_default(domain.parties(spark, d).where("partyAcronym = 'UVX'").select("partyAcronym", "fullName"))


@query("select Id in (select Id from laws) as is_there, Id from (values (1003), (-5)) t(Id)")
def proposal_exists(spark, d):
    asked = spark.createDataFrame([(1003,), (-5,)], "Id int")
    return requests._is_there(asked, "Id", domain.proposals(spark, d, "Id"), "Id", "is_there").select("Id", "is_there")


# Votes that are cast

_AT = "2024-01-02 12:00:00"
_BODIES = ['{"userID": 7, "projectLawID": 1003, "votingOrientation": "InFavor"}', '{"userID": 7, "projectLawID": 1003, "votingOrientation": "NotInterested"}', '{"userID": 7, "projectLawID": -5, "votingOrientation": "Against"}', '{"userID": -1, "projectLawID": 1003, "votingOrientation": "Against"}', '{"userID": 7, "projectLawID": 1003, "votingOrientation": "Maybe"}']


def cast(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables after five requests: a vote, another on the same proposal, an unknown proposal, an unknown user, an unknown orientation."""
    bodies = spark.createDataFrame(list(enumerate(_BODIES)), "request int, body string")
    asked = bodies.select("request", F.from_json("body", VOTE_REQUEST).alias("r")).select("request", "r.*")
    tables = requests.Tables(domain.votes(spark, d), domain.proposals(spark, d), domain.users(spark, d, "Id"), domain.stats(spark, d), domain.results(spark, d), domain.blocks(spark, d), domain.parties(spark, d))
    return requests.cast_votes(tables, asked, F.lit(_AT))


_HAS_RESULT = "(select count(*) from laws join voting_results r on r.Id = VotingResultGeneralityId where laws.Id = 1003)"


@query(f"select Id, VoteDate, ProjectLawID, VotingOrientation, UserId from ballots union all select (select max(Id) from ballots) + n, timestamp '{_AT}', 1003, o, 7 from (values (1, 0), (2, 3)) t(n, o) where {_HAS_RESULT} > 0")
def vote_cast(spark, d):
    """All votes after the requests."""
    return cast(spark, d)["votes"]


@query(f"select Id, totalAmountOfVotesFromUsers + v as totalAmountOfVotesFromUsers, amountOfUsersInterested + v // 2 as amountOfUsersInterested, case when v > 0 then (amountOfUsersInterested + v // 2) // (totalAmountOfVotesFromUsers + v) * 100 else Score end as Score from (select *, case when Id = 1003 and {_HAS_RESULT} > 0 then 2 else 0 end as v from laws)")
def vote_cast_proposals(spark, d):
    """The counters and scores of all proposals after the requests."""
    return cast(spark, d)["proposals"].select("Id", "totalAmountOfVotesFromUsers", "amountOfUsersInterested", "Score")


@query(
    """, law as (select VotingResultGeneralityId as gid, ProposingPartypartyAcronym as proposer from laws join voting_results r on r.Id = VotingResultGeneralityId where laws.Id = 1003),
steps as (select politicalPartyAcronym as party, n, b.Id as block_id, case when politicalPartyAcronym = proposer then case when votingOrientation = o then 10 else -2 end else case when votingOrientation = o then 9 else -1 end end as tenths
  from law join parts b on b.VotingResultId = gid join parties on partyAcronym = politicalPartyAcronym cross join (values (1, 0), (2, 3)) t(n, o)),
sums as (select *, sum(tenths) over (partition by party order by n, block_id) as s from steps),
folded as (select party, count(*) as n, sum(tenths) as added, min(s) as least from sums group by 1),
own as (select party, min(s.Id) as stat, any_value(n) as n, any_value(added) as added, any_value(least) as least from folded left join party_stats s on s.UserId = 7 and s.PoliticalPartypartyAcronym = party group by 1),
kept as (select s.Id, UserId, PoliticalPartypartyAcronym as party, coalesce(greatest(totalAffectionPoints + added / 10, added / 10 - least / 10), totalAffectionPoints) as points, totalAmountOfProposalsVotedOn + coalesce(n, 0) as amount, n is null as untouched, PartyAffectionScore as old from party_stats s left join own on stat = s.Id),
made as (select (select max(Id) from party_stats) + row_number() over (order by party) as Id, 7 as UserId, party, greatest(added, added - least) / 10 as points, n as amount, false as untouched, 0.0 as old from own where stat is null)
select Id, UserId, party, points, amount::int as amount, case when untouched then old else points / amount * 100 end as score from (select * from kept union all select * from made)"""
)
def vote_cast_stats(spark, d):
    """All party statistics after the requests."""
    return cast(spark, d)["stats"].select("Id", "UserId", F.col("PoliticalPartypartyAcronym").alias("party"), F.col("totalAffectionPoints").alias("points"), F.col("totalAmountOfProposalsVotedOn").alias("amount"), F.col("PartyAffectionScore").alias("score"))


@query(f"select * from (values (0, case when {_HAS_RESULT} = 0 then '{requests.NO_RESULT}' end), (1, case when {_HAS_RESULT} = 0 then '{requests.NO_RESULT}' end), (2, '{requests.NO_PROPOSAL}'), (3, '{requests.NO_USER}'), (4, '{requests.NO_ORIENTATION}')) t(request, outcome)")
def vote_cast_outcomes(spark, d):
    return cast(spark, d)["outcomes"]


# Records that are created

_BLOCKS = '[{"politicalPartyAcronym": "FRN", "numberOfDeputies": 12, "votingOrientation": "Against"}, {"politicalPartyAcronym": "UVX", "isUninamousWithinParty": true, "votingOrientation": "InFavor"}]'
_NEW_PROPOSALS = [
    '{"sourceId": 901, "legislatura": "XV", "score": 3, "voteDate": "2023-05-04", "proposingPartyAcronym": "UVX", "proposalTitle": "One", "fullProposalTextLink": "https://example.org/new/1", "proposalResult": "ApprovedInGenerality", "votingResultGenerality": {"isUninamous": false, "votingBlocks": ' + _BLOCKS + '}}',
    '{"legislatura": "XV", "voteDate": "2023-05-04", "proposalTitle": "No source", "fullProposalTextLink": "https://example.org/new/2"}',
    '{"proposalTitle": "Again, without source", "fullProposalTextLink": "https://example.org/new/1"}',
    '{"sourceId": 902, "legislatura": "XV", "voteDate": "2023-05-05", "proposingPartyAcronym": "nobody", "proposalTitle": "Two", "fullProposalTextLink": "https://example.org/new/3", "votingResultSpeciality": {"isUninamous": true, "votingBlocks": []}}',
]


def _created(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    taken = domain.proposals(spark, d, "Id", "FullProposalTextLink").where("Id = 1003").select(F.to_json(F.struct(F.col("FullProposalTextLink").alias("fullProposalTextLink"), F.lit(1).alias("sourceId"))).alias("body"), F.lit(9).alias("request"))
    bodies = spark.createDataFrame(list(enumerate(_NEW_PROPOSALS)), "request int, body string").unionByName(taken)
    asked = bodies.select("request", F.from_json("body", PROPOSAL_REQUEST).alias("r")).select("request", "r.*")
    return requests.create_proposals(domain.proposals(spark, d), domain.parties(spark, d), domain.results(spark, d), domain.blocks(spark, d), asked)


@query(
    "select (select max(Id) from laws) + n as Id, 900 + n as SourceId, 'XV' as Legislatura, 100 as Score, 0 as amountOfUsersInterested, 0 as totalAmountOfVotesFromUsers, concat('2023-05-0', 3 + n) as VoteDate, party as ProposingPartypartyAcronym, title as ProposalTitle, concat('https://example.org/new/', link) as FullProposalTextLink, res as ProposalResult, (select max(Id) from voting_results) + g as VotingResultGeneralityId, (select max(Id) from voting_results) + s as VotingResultSpecialityId from (values (1, 'UVX', 'One', 1, 2, 1, null), (2, null, 'Two', 3, null, null, 2)) t(n, party, title, link, res, g, s)"
)
def proposal_create(spark, d):
    """The proposals that four requests make."""
    return _created(spark, d)["proposals"].drop("ProposalTextHTML")


@query("select r + n as Id, n = 2 as \"isUninamous\" from (select (select max(Id) from voting_results) as r), (values (1), (2)) t(n)")
def proposal_create_results(spark, d):
    return _created(spark, d)["results"]


@query("select (select max(Id) from parts) + n as Id, (select max(Id) from voting_results) + 1 as VotingResultId, u as isUninamousWithinParty, k as numberOfDeputies, p as politicalPartyAcronym, o as votingOrientation from (values (1, null, 12, 'FRN', 1), (2, true, null, 'UVX', 0)) t(n, u, k, p, o)")
def proposal_create_blocks(spark, d):
    return _created(spark, d)["blocks"]


@query(f"select * from (values (0, null), (1, '{requests.NO_SOURCE}'), (2, '{requests.PROPOSAL_EXISTS}'), (3, null)) t(request, outcome) union all select 9, '{requests.PROPOSAL_EXISTS}' from laws where Id = 1003")
def proposal_create_outcomes(spark, d):
    """A taken link is tested before a missing source."""
    return _created(spark, d)["outcomes"]


@query(f"select request, case when acronym in (select partyAcronym from parties) or request = 2 then '{requests.PARTY_EXISTS}' end as outcome from (values (0, 'UVX'), (1, 'NEWP'), (2, 'NEWP')) t(request, acronym)")
def party_create(spark, d):
    asked = spark.createDataFrame([(0, "UVX", "Taken", "x"), (1, "NEWP", "New", "y"), (2, "NEWP", "New again", "z")], "request int, partyAcronym string, fullName string, logoLink string")
    return requests.create_parties(domain.parties(spark, d), asked)["outcomes"]


_NEW_USERS = [(0, "moinho_2", "new@example.org", "a", 1), (1, "newcomer_a", "moinho.2@example.org", "b", 1), (2, "newcomer_b", "newcomer@example.org", "c", 2), (3, "newcomer_c", "newcomer@example.org", "d", 3), (4, "newcomer_d", "other@example.org", "e", 4)]
_NEW_USERS_SQL = "(values (0, 'moinho_2', 'new@example.org'), (1, 'newcomer_a', 'moinho.2@example.org'), (2, 'newcomer_b', 'newcomer@example.org'), (3, 'newcomer_c', 'newcomer@example.org'), (4, 'newcomer_d', 'other@example.org')) t(request, name, email)"
_USER_OUTCOMES = f"select request, name, case when email in (select Email from people) or request = 3 then '{requests.EMAIL_EXISTS}' when name in (select UserName from people) then '{requests.NAME_EXISTS}' end as outcome from {_NEW_USERS_SQL}"


def _new_users(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    asked = spark.createDataFrame(_NEW_USERS, "request int, userName string, email string, password string, profilePic int")
    return requests.create_users(domain.users(spark, d), domain.stats(spark, d), domain.parties(spark, d), asked)


@query(f"select request, outcome, case when outcome is null then 200 when outcome like '%email%' then 401 else 402 end as status, case when outcome is null then 'created' when outcome like '%email%' then 'EmailHasAccount' else 'UsernameAlreadyExists' end as said from ({_USER_OUTCOMES})")
def user_create(spark, d):
    """What five sign-ups are answered, as message, status and what the client makes of the status."""
    outcomes = _new_users(spark, d)["outcomes"]
    status = F.when(F.col("outcome").isNull(), 200).when(F.col("outcome") == requests.EMAIL_EXISTS, 401).otherwise(402)
    return outcomes.withColumn("status", status).withColumn("said", text.outcome_of_status(F.col("status")))


@query(f"select (select max(Id) from party_stats) + row_number() over (order by u, partyAcronym) as Id, (select max(Id) from people) + u as UserId, partyAcronym as PoliticalPartypartyAcronym, 0.0::double as PartyAffectionScore, 0 as totalAmountOfProposalsVotedOn, 0.0::double as totalAffectionPoints from (select row_number() over (order by request) as u from ({_USER_OUTCOMES}) where outcome is null) cross join parties")
def user_create_stats(spark, d):
    """The empty statistics of the users that are made."""
    return _new_users(spark, d)["stats"]


# Nested rows


def users_nested(spark: SparkSession, d: str) -> DataFrame:
    """Users with their votes and their statistics, each of these with its party."""
    stats = nesting.with_parent(domain.stats(spark, d), "PoliticalPartypartyAcronym", domain.parties(spark, d), "partyAcronym", "party", "inner")
    votes = domain.votes(spark, d).select("UserId", "Id", "VoteDate", "ProjectLawID", "VotingOrientation")
    rows = nesting.with_children(domain.users(spark, d, "Id", "UserName", "Email", "ProfilePic", "googleIDToken", "facebookIDToken"), "Id", votes, "UserId", "votes")
    return nesting.with_children(rows, "Id", stats, "UserId", "partyStats")


@query("select p.Id, UserName, v.Id as vote_id, VoteDate, ProjectLawID, VotingOrientation from people p left join ballots v on v.UserId = p.Id")
def users_nested_votes(spark, d):
    """The votes within the nested users; a user without votes keeps a row."""
    return users_nested(spark, d).select("Id", "UserName", F.explode_outer("votes").alias("v")).select("Id", "UserName", F.col("v.Id").alias("vote_id"), "v.VoteDate", "v.ProjectLawID", "v.VotingOrientation")


@query("select p.Id, UserName, s.Id as stat_id, fullName, logoLink, PartyAffectionScore, totalAmountOfProposalsVotedOn, totalAffectionPoints from people p left join (select * from party_stats join parties on partyAcronym = PoliticalPartypartyAcronym) s on s.UserId = p.Id")
def users_nested_stats(spark, d):
    """The statistics within the nested users, with their parties."""
    rows = users_nested(spark, d).select("Id", "UserName", F.explode_outer("partyStats").alias("s"))
    return rows.select("Id", "UserName", F.col("s.Id").alias("stat_id"), "s.party.fullName", "s.party.logoLink", "s.PartyAffectionScore", "s.totalAmountOfProposalsVotedOn", "s.totalAffectionPoints")


def proposals_nested(spark: SparkSession, d: str) -> DataFrame:
    """Proposals with their party and both results, each of these with its blocks."""
    results = nesting.with_children(domain.results(spark, d), "Id", domain.blocks(spark, d), "VotingResultId", "votingBlocks")
    rows = nesting.with_parent(domain.proposals(spark, d), "VotingResultGeneralityId", results, "Id", "votingResultGenerality")
    rows = nesting.with_parent(rows, "VotingResultSpecialityId", results, "Id", "votingResultSpeciality")
    return nesting.with_parent(rows, "ProposingPartypartyAcronym", domain.parties(spark, d), "partyAcronym", "proposingParty")


@query("select l.Id, fullName, stage, r.Id as result_id, r.isUninamous, b.Id as block_id, politicalPartyAcronym, votingOrientation, numberOfDeputies, isUninamousWithinParty from (select *, 'generality' as stage, VotingResultGeneralityId as rid from laws union all select *, 'speciality', VotingResultSpecialityId from laws) l left join parties on partyAcronym = ProposingPartypartyAcronym left join voting_results r on r.Id = rid left join parts b on b.VotingResultId = r.Id")
def proposals_nested_blocks(spark, d):
    """The blocks within both results of the nested proposals; a stage without result or block keeps a row."""
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("result")) for s, c in (("generality", "votingResultGenerality"), ("speciality", "votingResultSpeciality"))])
    rows = proposals_nested(spark, d).select("Id", "proposingParty.fullName", F.explode(stages).alias("s"))
    rows = rows.select("Id", "fullName", "s.stage", F.col("s.result.Id").alias("result_id"), "s.result.isUninamous", F.explode_outer("s.result.votingBlocks").alias("b"))
    return rows.select("*", F.col("b.Id").alias("block_id"), "b.politicalPartyAcronym", "b.votingOrientation", "b.numberOfDeputies", "b.isUninamousWithinParty").drop("b")


# Records out and in


def proposal_records(spark: SparkSession, d: str) -> DataFrame:
    """One JSON text per proposal as services send it: nested, codes as names."""
    block = lambda b: F.struct("b.Id") if b is None else F.struct(b["Id"].alias("id"), b["isUninamousWithinParty"].alias("isUninamousWithinParty"), b["numberOfDeputies"].alias("numberOfDeputies"), b["politicalPartyAcronym"].alias("politicalPartyAcronym"), text.enum_name(b["votingOrientation"], ORIENTATIONS).alias("votingOrientation"))
    result = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["Id"].alias("id"), F.col(c)["isUninamous"].alias("isUninamous"), F.transform(F.col(c)["votingBlocks"], block).alias("votingBlocks"))).alias(c)
    return records.as_json(
        proposals_nested(spark, d).select(
            F.col("Id").alias("id"),
            F.col("ProposalTitle").alias("proposalTitle"),
            F.col("Legislatura").alias("legislatura"),
            F.col("VoteDate").alias("voteDate"),
            F.col("FullProposalTextLink").alias("fullProposalTextLink"),
            text.enum_name(F.col("ProposalResult"), PROPOSAL_RESULTS).alias("proposalResult"),
            "proposingParty",
            result("votingResultGenerality"),
            result("votingResultSpeciality"),
        )
    )


@query(
    "select l.Id as id, ProposalTitle as title, Legislatura as legislatura, VoteDate as \"voteDate\", FullProposalTextLink as \"fullTextUrl\", ProposalResult as \"votingResult\", partyAcronym as \"partyAcronym\", fullName as \"partyName\", logoLink as \"logoUrl\", g.isUninamous as \"isUnanimous\", b.n as \"nBlocks\", b.k as \"nDeputies\", b.o as orientations from laws l left join parties on partyAcronym = ProposingPartypartyAcronym left join voting_results g on g.Id = VotingResultGeneralityId left join (select r.Id, count(b.Id)::int as n, coalesce(sum(numberOfDeputies), 0)::bigint as k, coalesce(string_agg(coalesce(votingOrientation::varchar, ''), ',' order by b.Id), '') as o from voting_results r left join parts b on b.VotingResultId = r.Id group by 1) b on b.Id = g.Id"
)
def client_proposals(spark, d):
    """Proposals written as JSON and read back as the client's records, under its names."""
    parsed = records.parsed(proposal_records(spark, d), "json", records.PROPOSAL_RECORD)
    rows = records.client_proposal(parsed)
    blocks = F.col("votingResultInGenerality.votingBlocks")
    return rows.select(
        "id", "title", "legislatura", "voteDate", "fullTextUrl", "votingResult", "proposingParty.*", "votingResultInGenerality.isUnanimous", F.when(blocks.isNotNull(), F.size(blocks)).alias("nBlocks"),
        F.aggregate(blocks, F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(b["numberOfDeputados"], F.lit(0))).alias("nDeputies"), F.array_join(F.transform(blocks, lambda b: F.coalesce(b["voteOrientation"].cast("string"), F.lit(""))), ",").alias("orientations"),
    )


def user_records(spark: SparkSession, d: str) -> DataFrame:
    """One JSON text per user as services send it."""
    vote = lambda v: F.struct(v["Id"].alias("id"), v["ProjectLawID"].alias("projectLawID"), text.enum_name(v["VotingOrientation"], ORIENTATIONS).alias("votingOrientation"), v["VoteDate"].cast("string").alias("voteDate"))
    stat = lambda s: F.struct(s["party"].alias("politicalParty"), s["PartyAffectionScore"].alias("partyAffectionScore"), s["totalAmountOfProposalsVotedOn"].alias("totalAmountOfProposalsVotedOn"), s["totalAffectionPoints"].alias("totalAffectionPoints"))
    rows = users_nested(spark, d)
    return records.as_json(
        rows.select(F.col("Id").alias("id"), F.col("UserName").alias("userName"), F.col("Email").alias("email"), F.col("ProfilePic").alias("profilePic"), "googleIDToken", "facebookIDToken", F.transform("votes", vote).alias("votes"), F.transform("partyStats", stat).alias("partyStats"))
    )


@query(
    "select p.Id as \"userId\", UserName as name, Email as email, ProfilePic as \"profilePictureId\", case when googleIDToken is not null then 'google' when facebookIDToken is not null then 'facebook' else 'email' end as \"userType\", coalesce(v.n, 0)::int as \"nVotes\", coalesce(v.ids, '') as \"proposalIDs\", coalesce(s.n, 0)::int as \"nStats\", s.best from people p left join (select UserId, count(*) as n, string_agg(coalesce(ProjectLawID::varchar, ''), ',' order by Id) as ids from ballots group by 1) v on v.UserId = p.Id left join (select UserId, count(*) as n, max(PartyAffectionScore) as best from party_stats join parties on partyAcronym = PoliticalPartypartyAcronym group by 1) s on s.UserId = p.Id"
)
def client_users(spark, d):
    """Users written as JSON and read back as the client's records, under its names."""
    rows = records.client_user(records.parsed(user_records(spark, d), "json", records.USER_RECORD))
    votes = F.array_join(F.transform("userVotes", lambda v: F.coalesce(v["proposalID"].cast("string"), F.lit(""))), ",")
    return rows.select("userId", "name", "email", "profilePictureId", "userType", F.size("userVotes").alias("nVotes"), votes.alias("proposalIDs"), F.size("partyStats").alias("nStats"), F.array_max(F.col("partyStats.partyAffectionScore")).alias("best"))


@query("select to_json({Id: l.Id, ProposalTitle: ProposalTitle, Score: Score, VotingResultSpecialityId: VotingResultSpecialityId})::varchar as json from laws l")
def proposal_json(spark, d):
    return records.as_json(domain.proposals(spark, d).select("Id", "ProposalTitle", "Score", "VotingResultSpecialityId"))


_NAME_OF = "case votingOrientation when 0 then 'InFavor' when 1 then 'Against' when 2 then 'Abstaining' when 3 then 'NotInterested' end"


@query(f"select Id, to_json({{userID: UserId, projectLawID: ProjectLawID, votingOrientation: {_NAME_OF}}})::varchar as json from ballots")
def vote_json(spark, d):
    """Votes as the client sends them."""
    return domain.votes(spark, d).select("Id", records.vote_json(F.col("UserId"), F.col("ProjectLawID"), F.col("VotingOrientation")).alias("json"))


@query("select Id, case when contains(Email, '@') then to_json({email: Email, password: sha256(Password)})::varchar else to_json({userName: Email, password: sha256(Password)})::varchar end as json from people")
def login_json(spark, d):
    """Logins as the client sends them."""
    return domain.users(spark, d).select("Id", records.login_json(F.col("Email"), F.col("Password")).alias("json"))


@query("select partyAcronym, to_json({partyAcronym: partyAcronym, partyName: fullName, logoUrl: logoLink})::varchar as json from parties")
def party_json(spark, d):
    return domain.parties(spark, d).select("partyAcronym", records.party_json(F.col("partyAcronym"), F.col("fullName"), F.col("logoLink")).alias("json"))


@query(f"select Id, to_json({{isUnanimousWithinParty: isUninamousWithinParty, numberOfDeputados: numberOfDeputies, politicalParty: politicalPartyAcronym, voteOrientation: {_NAME_OF}}})::varchar as json from parts")
def block_json(spark, d):
    return domain.blocks(spark, d).select("Id", records.block_json(F.col("isUninamousWithinParty"), F.col("numberOfDeputies"), F.col("politicalPartyAcronym"), F.col("votingOrientation")).alias("json"))


@query("select s.Id, to_json({political_party: {partyAcronym: partyAcronym, partyName: fullName, logoUrl: logoLink}, party_affection_score: PartyAffectionScore, total_amount_of_proposals_voted_on: totalAmountOfProposalsVotedOn, total_affection_points: totalAffectionPoints})::varchar as json from party_stats s join parties on partyAcronym = PoliticalPartypartyAcronym")
def stats_json(spark, d):
    rows = nesting.with_parent(domain.stats(spark, d), "PoliticalPartypartyAcronym", domain.parties(spark, d), "partyAcronym", "party", "inner")
    return rows.select("Id", records.stats_json(F.col("party"), F.col("PartyAffectionScore"), F.col("totalAmountOfProposalsVotedOn"), F.col("totalAffectionPoints")).alias("json"))


@query("select Id, to_json({userID: Id, legislaturas: ['XIV', 'XV'], oldestVoteDate: '2015-01-01', newestVoteDate: null::varchar, lowestScoreAllowed: 0})::varchar as json from people")
def criteria_json(spark, d):
    """Criteria of every user as the client sends them."""
    legislatures = F.array(F.lit("XIV"), F.lit("XV"))
    return domain.users(spark, d, "Id").select("Id", records.criteria_json(F.col("Id"), legislatures, F.lit("2015-01-01"), F.lit(None).cast("string"), F.lit(None).cast("int")).alias("json"))


# Integrity, changes of tables, shapes


@query("select 'proposals' as table_name, ProposingPartypartyAcronym as acronym, count(*) as n_rows from laws where ProposingPartypartyAcronym not in (select partyAcronym from parties) or ProposingPartypartyAcronym is null group by 1, 2 union all select 'party_stats', PoliticalPartypartyAcronym, count(*) from party_stats where PoliticalPartypartyAcronym not in (select partyAcronym from parties) or PoliticalPartypartyAcronym is null group by 1, 2")
def required_references(spark, d):
    """Parties that proposals and statistics must have and that are not there, with the rows that name them."""
    found = None
    for name, rows, c in (("proposals", domain.proposals(spark, d, "Id", "ProposingPartypartyAcronym"), "ProposingPartypartyAcronym"), ("party_stats", domain.stats(spark, d), "PoliticalPartypartyAcronym")):
        lost = nesting.without(rows, c, domain.parties(spark, d), "partyAcronym").groupBy(F.col(c).alias("acronym")).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "acronym", "n_rows")
        found = lost if found is None else found.unionAll(lost)
    return found


@query("select Id, case when UserId = 7 then null else UserId end as UserId, PoliticalPartypartyAcronym from party_stats")
def delete_user_stats(spark, d):
    """The statistics after their user was deleted: kept without user."""
    return mutations.detached(domain.stats(spark, d).select("Id", "UserId", "PoliticalPartypartyAcronym"), "UserId", 7)


@query("select partyAcronym, case when partyAcronym = 'UVX' then 'https://static.example.org/new.png' else logoLink end as logoLink from parties where partyAcronym <> 'FRN' union all select 'NEWP', 'https://static.example.org/newp.png'")
def reseeded_parties(spark, d):
    """Seed data changed by a migration: a row removed, a value updated, a row inserted."""
    inserted = spark.createDataFrame([("NEWP", "https://static.example.org/newp.png"), ("UVX", "kept out")], "partyAcronym string, logoLink string")
    patch = spark.createDataFrame([("UVX", "https://static.example.org/new.png")], "partyAcronym string, logoLink string")
    return mutations.reseeded(domain.parties(spark, d).select("partyAcronym", "logoLink"), "partyAcronym", inserted, patch, ["FRN"])


@query("select Id, Score::varchar as Score, VoteDate from laws")
def retyped_proposals(spark, d):
    """A column of another type."""
    return mutations.migrated(domain.proposals(spark, d).select("Id", "Score", "VoteDate"), {}, {}, retyped={"Score": "string"})


@query("select Id, bucket, VotingOrientation = code as highlighted from ballots, (values ('n_for', 0), ('n_abstaining', 2), ('n_against', 1)) t(bucket, code)")
def highlighted_bucket(spark, d):
    """Which of the three buckets of a result is marked as a user's own."""
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(c).alias("code")) for b, c in (("n_for", 0), ("n_abstaining", 2), ("n_against", 1))])
    return domain.votes(spark, d).select("Id", "VotingOrientation", F.explode(buckets).alias("b")).select("Id", "b.bucket", (F.col("VotingOrientation") == F.col("b.code")).alias("highlighted"))
