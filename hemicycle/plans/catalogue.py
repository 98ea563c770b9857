"""Queries of the relational operators on the stored tables, each with its SQL for DuckDB.

Results are flat: nested columns come as sizes, sums and joined texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from hemicycle.functions import text
from hemicycle.operators import filters, mutations, nesting, picking, scoring
from hemicycle.plans import domain
from hemicycle.schemas import ORIENTATIONS, PROPOSAL_RESULTS
from hemicycle.session import spread
from hemicycle.sources import records
from hemicycle.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_COLUMNS = ", ".join(domain.PROPOSAL_COLUMNS)
_WITH = f"""with laws as (select distinct {_COLUMNS} from proposals),
people as (select distinct * from users),
parts as (select distinct * from voting_blocks),
ballots as (select Id, min(VoteDate) as VoteDate, min(ProjectLawID) as ProjectLawID, min(VotingOrientation) as VotingOrientation, min(UserId) as UserId from votes group by Id)
"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL after the common tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.startswith(_WITH) else _WITH + sql
        return f

    return register


# Scans and literal sources


@query("select * from parties")
def scan_parties(spark, d):
    return domain.parties(spark, d)


@query("select Id, UserName, Email, ProfilePic from people")
def scan_users(spark, d):
    return domain.users(spark, d, "Id", "UserName", "Email", "ProfilePic")


@query("select * from laws")
def scan_proposals(spark, d):
    return domain.proposals(spark, d)


@query("select * from (values " + ", ".join(f"('{a}', '{n}', 'https://static.example.org/{a.lower()}.png')" for a, n in records.SEED_PARTIES) + ") t(partyAcronym, fullName, logoLink)")
def seed_parties(spark, d):
    return records.seed_parties(spark)


@query("select 'Hello World' as greeting")
def greeting(spark, d):
    return records.single_row(spark, greeting="Hello World")


@query("select record_id, json_extract_string(payload, '$.id') as id, json_extract_string(payload, '$.legislatura') as legislatura, json_extract_string(payload, '$.voteDate') as \"voteDate\", json_extract_string(payload, '$.proposalTitle') as title from proposal_records where json_valid(payload) and json_type(payload) = 'OBJECT' and json_extract_string(payload, '$.legislatura') is not null")
def parsed_records(spark, d):
    """Fields of records that are plain objects in the usual spelling; problem 5 reads all spellings."""
    rows = read_table(spark, d, "proposal_records", "record_id", "payload")
    whole = rows.where(F.expr("try_parse_json(payload)").isNotNull() & F.col("payload").rlike(r"^\s*\{"))
    return whole.select("record_id", F.from_json("payload", "id string, legislatura string, voteDate string, proposalTitle string").alias("r")).select("record_id", "r.id", "r.legislatura", "r.voteDate", F.col("r.proposalTitle").alias("title")).where("legislatura is not null")


# Filters and searches


@query("select Id, ProposalTitle, Legislatura from laws where Legislatura in ('XIV', 'XV')")
def filter_legislatura_in(spark, d):
    return filters.by_criteria(domain.proposals(spark, d), legislatures=["XIV", "XV"]).select("Id", "ProposalTitle", "Legislatura")


@query("select Id, VoteDate from laws where VoteDate >= '2016-01-01' and VoteDate <= '2019-12-31' and Score >= 0")
def filter_vote_date_range(spark, d):
    return filters.by_criteria(domain.proposals(spark, d), oldest="2016-01-01", newest="2019-12-31").select("Id", "VoteDate")


@query("select Id, Score from laws where Score >= 50")
def filter_min_score(spark, d):
    return filters.by_criteria(domain.proposals(spark, d), lowest_score=50).select("Id", "Score")


_CRITERIA = {"legislatures": ["XIII", "XIV", "XV"], "oldest": "2015-01-01", "newest": "2022-12-31", "lowest_score": 1}
_CRITERIA_SQL = "Legislatura in ('XIII', 'XIV', 'XV') and VoteDate >= '2015-01-01' and VoteDate <= '2022-12-31' and Score >= 1"


@query(f"select Id, Legislatura, VoteDate, Score from laws where {_CRITERIA_SQL}")
def criteria_combined(spark, d):
    return filters.by_criteria(domain.proposals(spark, d), **_CRITERIA).select("Id", "Legislatura", "VoteDate", "Score")


@query("select Id, SourceId, ProposalTitle from laws where contains(lower(ProposalTitle), '7') or contains(cast(SourceId as varchar), '7')")
def search_title_or_source(spark, d):
    return filters.search(domain.proposals(spark, d), "7", "ProposalTitle", "SourceId").select("Id", "SourceId", "ProposalTitle")


@query("select Id, ProposalTitle from laws where contains(lower(ProposalTitle), 'ruído')")
def search_title(spark, d):
    return filters.search(domain.proposals(spark, d), "RUÍDO", "ProposalTitle").select("Id", "ProposalTitle")


@query("select partyAcronym, fullName from parties where contains(lower(partyAcronym), 'e')")
def search_party(spark, d):
    return filters.search(domain.parties(spark, d), "E", "partyAcronym").select("partyAcronym", "fullName")


@query("select Id, UserName from people where contains(lower(UserName), 'moinho')")
def search_user(spark, d):
    return filters.search(domain.users(spark, d), "Moinho", "UserName").select("Id", "UserName")


@query("select Id, ProposalTitle from laws")
def search_empty_returns_all(spark, d):
    return filters.search(domain.proposals(spark, d), "", "ProposalTitle", "SourceId").select("Id", "ProposalTitle")


@query("select VotingOrientation as code, count(*) as n_votes from ballots where VotingOrientation is null or VotingOrientation not in (0, 1, 2, 3) group by 1")
def validate_enum(spark, d):
    return filters.invalid_codes(domain.votes(spark, d), "VotingOrientation", list(ORIENTATIONS)).groupBy(F.col("VotingOrientation").alias("code")).agg(F.count("*").alias("n_votes"))


@query("select column_name, n_missing from (select count(*) - count(VotingResultId) as VotingResultId, count(*) - count(numberOfDeputies) as numberOfDeputies, count(*) - count(isUninamousWithinParty) as isUninamousWithinParty from parts) unpivot (n_missing for column_name in (VotingResultId, numberOfDeputies, isUninamousWithinParty))")
def validate_required(spark, d):
    return filters.missing_values(domain.blocks(spark, d), "VotingResultId", "numberOfDeputies", "isUninamousWithinParty")


@query("select Id, count(*) as n_rows from proposals group by Id having count(*) > 1")
def pk_violations(spark, d):
    return filters.duplicate_keys(read_table(spark, d, "proposals", "Id"), "Id")


# Messages that clients show for a login.
NAME_MISSING, EMAIL_INVALID, PASSWORD_MISSING = "Username is required", "Invalid email", "Password is required"
_EMAIL_SQL = text.EMAIL.replace("'", "''")


def _login_errors(rows, identifier):
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [(NAME_MISSING, empty(identifier)), (EMAIL_INVALID, F.col(identifier).contains("@") & ~text.looks_like_email(F.col(identifier))), (PASSWORD_MISSING, empty("Password"))]
    return rows.select("Id", filters.first_broken_rule(rules).alias("error"))


def _login_errors_sql(c):
    return f"select Id, case when coalesce({c}, '') = '' then '{NAME_MISSING}' when contains({c}, '@') and not regexp_matches({c}, '{_EMAIL_SQL}') then '{EMAIL_INVALID}' when coalesce(Password, '') = '' then '{PASSWORD_MISSING}' end as error from people"


@query(_login_errors_sql("UserName"))
def validate_users(spark, d):
    """The first rule that each user would break by a login with the name, null for none."""
    return _login_errors(domain.users(spark, d), "UserName")


@query(_login_errors_sql("Email"))
def validate_emails(spark, d):
    """The same with the address: one field takes either."""
    return _login_errors(domain.users(spark, d), "Email")


# Lookups and nesting


def _with_results(spark, d):
    rows = nesting.with_parent(domain.proposals(spark, d), "VotingResultGeneralityId", domain.results(spark, d), "Id", "generality")
    return nesting.with_parent(rows, "VotingResultSpecialityId", domain.results(spark, d), "Id", "speciality")


@query("select l.Id, g.isUninamous as generality_unanimous, s.isUninamous as speciality_unanimous from laws l left join voting_results g on g.Id = VotingResultGeneralityId left join voting_results s on s.Id = VotingResultSpecialityId")
def proposal_results_left(spark, d):
    return _with_results(spark, d).select("Id", F.col("generality.isUninamous").alias("generality_unanimous"), F.col("speciality.isUninamous").alias("speciality_unanimous"))


@query("select l.Id, fullName, VotingResultGeneralityId as generality_id, (select count(*) from parts b where b.VotingResultId = l.VotingResultGeneralityId) as n_blocks from laws l join parties on partyAcronym = ProposingPartypartyAcronym where l.Id = 1003")
def proposal_by_id(spark, d):
    one = domain.proposals(spark, d).where("Id = 1003")
    rows = nesting.with_parent(one, "ProposingPartypartyAcronym", domain.parties(spark, d), "partyAcronym", "party", "inner")
    rows = nesting.with_children(rows, "VotingResultGeneralityId", domain.blocks(spark, d), "VotingResultId", "blocks")
    return rows.select("Id", "party.fullName", F.col("VotingResultGeneralityId").alias("generality_id"), F.size("blocks").cast("bigint").alias("n_blocks"))


@query("select Id, fullName from laws join parties on partyAcronym = ProposingPartypartyAcronym")
def proposal_with_party(spark, d):
    return nesting.with_parent(domain.proposals(spark, d), "ProposingPartypartyAcronym", domain.parties(spark, d), "partyAcronym", "party", "inner").select("Id", "party.fullName")


@query("select r.Id, r.isUninamous, count(b.Id) as n_blocks, coalesce(sum(numberOfDeputies), 0)::bigint as n_deputies, coalesce(string_agg(politicalPartyAcronym, '|' order by b.Id), '') as acronyms from voting_results r left join parts b on b.VotingResultId = r.Id group by 1, 2")
def proposal_blocks_nested(spark, d):
    rows = nesting.with_children(domain.results(spark, d), "Id", domain.blocks(spark, d), "VotingResultId", "blocks")
    total = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(b["numberOfDeputies"], F.lit(0)))
    return rows.select("Id", "isUninamous", F.size("blocks").cast("bigint").alias("n_blocks"), total.alias("n_deputies"), F.array_join(F.col("blocks.politicalPartyAcronym"), "|").alias("acronyms"))


@query("select p.Id, count(v.Id) as n_votes, max(v.VoteDate) as last_vote from (select distinct Id from people) p left join ballots v on v.UserId = p.Id group by 1")
def user_votes_nested(spark, d):
    """Number and last date of the votes within each user's array; users without votes have none. ``users_nested_votes`` has the votes themselves."""
    rows = nesting.with_children(domain.users(spark, d, "Id"), "Id", domain.votes(spark, d).select("UserId", "Id", "VoteDate", "ProjectLawID", "VotingOrientation").withColumnRenamed("Id", "VoteId"), "UserId", "votes")
    return rows.select("Id", F.size("votes").cast("bigint").alias("n_votes"), F.array_max(F.col("votes.VoteDate")).alias("last_vote"))


@query("select UserId, fullName, count(*) as n_stats, sum(totalAmountOfProposalsVotedOn)::bigint as n_proposals from party_stats join parties on partyAcronym = PoliticalPartypartyAcronym where UserId in (select Id from people) group by 1, 2")
def user_party_stats(spark, d):
    stats = nesting.with_parent(domain.stats(spark, d), "PoliticalPartypartyAcronym", domain.parties(spark, d), "partyAcronym", "party", "inner")
    rows = nesting.with_children(domain.users(spark, d, "Id"), "Id", stats, "UserId", "stats").select(F.col("Id").alias("UserId"), F.explode("stats").alias("s"))
    return rows.groupBy("UserId", "s.party.fullName").agg(F.count("*").alias("n_stats"), F.sum("s.totalAmountOfProposalsVotedOn").alias("n_proposals"))


@query("select Id from laws where Id not in (select ProjectLawID from ballots where UserId = 7)")
def unvoted_proposals(spark, d):
    return nesting.without(domain.proposals(spark, d).select("Id"), "Id", domain.votes(spark, d).where("UserId = 7").select("ProjectLawID").distinct(), "ProjectLawID")


@query("select Id from laws")
def unvoted_unknown_user(spark, d):
    return nesting.without(domain.proposals(spark, d).select("Id"), "Id", domain.votes(spark, d).where("UserId = -987654").select("ProjectLawID"), "ProjectLawID")


@query("select b.Id, politicalPartyAcronym, fullName from parts b left join parties on partyAcronym = politicalPartyAcronym")
def block_party_lookup(spark, d):
    return nesting.with_parent(domain.blocks(spark, d), "politicalPartyAcronym", domain.parties(spark, d), "partyAcronym", "party").select("Id", "politicalPartyAcronym", "party.fullName")


@query("select p.Id as UserId, partyAcronym, 0.0::double as PartyAffectionScore, 0 as totalAmountOfProposalsVotedOn, 0.0::double as totalAffectionPoints from people p, parties")
def seed_user_party_stats(spark, d):
    rows = nesting.for_each(domain.users(spark, d, "Id"), domain.parties(spark, d), "partyAcronym")
    return rows.select(F.col("Id").alias("UserId"), "partyAcronym", F.lit(0.0).alias("PartyAffectionScore"), F.lit(0).alias("totalAmountOfProposalsVotedOn"), F.lit(0.0).alias("totalAffectionPoints"))


@query("select b.Id, (select min(s.Id) from party_stats s where s.UserId = 7 and s.PoliticalPartypartyAcronym = b.politicalPartyAcronym) as stat_id from parts b")
def block_stat_lookup(spark, d):
    """The statistic that one user has for the party of each block, if any."""
    own = domain.stats(spark, d).where("UserId = 7").select("PoliticalPartypartyAcronym", "Id")
    return nesting.with_parent(domain.blocks(spark, d), "politicalPartyAcronym", own, "PoliticalPartypartyAcronym", "stat").select("Id", F.col("stat.Id").alias("stat_id"))


# Counters, scores, affinity

_SCORED = """, scored as (select v.*, VotingResultGeneralityId as gid, ProposingPartypartyAcronym as proposer from ballots v join laws l on l.Id = v.ProjectLawID join voting_results r on r.Id = VotingResultGeneralityId),
steps as (select v.UserId, v.Id as vote_id, b.Id as block_id, politicalPartyAcronym as party,
  case when politicalPartyAcronym = proposer then case when b.votingOrientation = v.VotingOrientation then 10 else -2 end else case when b.votingOrientation = v.VotingOrientation then 9 else -1 end end as tenths
  from scored v join parts b on b.VotingResultId = gid join parties on partyAcronym = politicalPartyAcronym where v.UserId is not null)
"""
_AFFINITY = (
    _SCORED
    + """, sums as (select *, sum(tenths) over (partition by UserId, party order by vote_id, block_id rows unbounded preceding) as s from steps),
lows as (select *, min(s) over (partition by UserId, party order by vote_id, block_id rows unbounded preceding) as m, row_number() over (partition by UserId, party order by vote_id desc, block_id desc) as back from sums),
affinity as (select UserId, party, s, m from lows where back = 1)
select a.UserId, a.party, n.n_steps, (a.s - least(0, a.m)) / 10.0::double as points, (a.s - least(0, a.m)) / 10.0::double / n.n_steps * 100 as affinity
from affinity a join (select UserId, party, count(*) as n_steps from steps group by 1, 2) n on n.UserId = a.UserId and n.party = a.party"""
)


def _laws(spark, d):
    """Proposals with a stored generality result."""
    laws = domain.proposals(spark, d, "Id", "ProposingPartypartyAcronym", "VotingResultGeneralityId").select(F.col("Id").alias("ProjectLawID"), F.col("ProposingPartypartyAcronym").alias("proposer"), F.col("VotingResultGeneralityId").alias("result_id"))
    return laws.join(domain.results(spark, d).select(F.col("Id").alias("result_id")), "result_id", "left_semi")


def _scored_votes(spark, d, votes=None):
    """Votes on proposals with a stored generality result."""
    return (domain.votes(spark, d) if votes is None else votes).join(_laws(spark, d), "ProjectLawID")


def _known_blocks(spark, d):
    parts = domain.blocks(spark, d, "Id", "VotingResultId", "politicalPartyAcronym", "votingOrientation").select(F.col("VotingResultId").alias("result_id"), F.col("Id").alias("block_id"), F.col("politicalPartyAcronym").alias("party"), F.col("votingOrientation").alias("block_orientation"))
    return parts.join(domain.parties(spark, d).select(F.col("partyAcronym").alias("party")), "party", "left_semi")


def _points():
    return scoring.tenths(F.col("party") == F.col("proposer"), F.col("block_orientation") == F.col("VotingOrientation")).alias("tenths")


def affinity_steps(spark, d, votes=None):
    """One row per scored vote and block of the vote's generality result."""
    return _scored_votes(spark, d, votes).where("UserId is not null").join(_known_blocks(spark, d), "result_id").select("UserId", F.col("Id").alias("vote_id"), "block_id", "party", _points())


def affinity_steps_by_user(spark, d, votes=None):
    """The rows of ``affinity_steps``, with those of a user in one partition: a vote is shuffled once, with its blocks in arrays, and not once for each block."""
    placed = _known_blocks(spark, d).withColumn("first", F.min("block_id").over(Window.partitionBy("result_id"))).withColumn("place", F.col("block_id").cast("bigint") - F.col("first"))  # places repeat from result to result, so they compress; ids don't
    of_block = ("place", "party", "block_orientation")
    by_result = placed.groupBy("result_id", "first").agg(F.array_sort(F.collect_list(F.struct(*of_block))).alias("_blocks")).select("result_id", "first", *[F.col("_blocks")[c].alias(c) for c in of_block])
    laws = _laws(spark, d).join(by_result, "result_id").drop("result_id")
    given = (domain.votes(spark, d) if votes is None else votes).where("UserId is not null").select("UserId", F.col("Id").alias("vote_id"), "ProjectLawID", "VotingOrientation")
    points = F.zip_with("party", "block_orientation", lambda party, orientation: scoring.tenths(party == F.col("proposer"), orientation == F.col("VotingOrientation")).cast("tinyint"))
    gathered = given.join(laws, "ProjectLawID").select("UserId", "vote_id", "first", "place", "party", points.alias("tenths")).repartition("UserId")
    each = gathered.select("UserId", "vote_id", "first", F.inline(F.arrays_zip("place", "party", "tenths")))
    return each.select("UserId", "vote_id", (F.col("first") + F.col("place")).cast("int").alias("block_id"), "party", F.col("tenths").cast("int").alias("tenths"))


def _affinity(folded):
    return folded.select("UserId", "party", "n_steps", (F.col("total") / 10).alias("points"), (F.col("total") / 10 / F.col("n_steps") * 100).alias("affinity"))


@query("select ProjectLawID as proposal_id, count(*) as n_votes, sum(case when VotingOrientation <> 3 then 1 else 0 end)::bigint as n_interested from ballots group by 1")
def proposal_vote_counters(spark, d):
    return scoring.vote_counters(domain.votes(spark, d), "ProjectLawID", "VotingOrientation").drop("score")


@query(_SCORED.rsplit(",\nsteps", 1)[0] + " select ProjectLawID as proposal_id, count(*) as n_votes, sum(case when VotingOrientation <> 3 then 1 else 0 end)::bigint as n_interested, (sum(case when VotingOrientation <> 3 then 1 else 0 end)::bigint // count(*)) * 100 as score from scored group by 1")
def proposal_score(spark, d):
    return scoring.vote_counters(_scored_votes(spark, d), "ProjectLawID", "VotingOrientation")


@query(_SCORED.rsplit(",\nsteps", 1)[0] + ", counted as (select ProjectLawID, count(*) as n, sum(case when VotingOrientation <> 3 then 1 else 0 end)::bigint as i from scored group by 1) select Id, coalesce(n, 0) as n_votes, coalesce((i // n) * 100, 100) as score from laws left join counted on ProjectLawID = Id")
def proposal_score_all(spark, d):
    """The score of every proposal; 100, as at the start, for those without a vote that counts."""
    counted = scoring.vote_counters(_scored_votes(spark, d), "ProjectLawID", "VotingOrientation")
    rows = domain.proposals(spark, d, "Id").join(counted, F.col("Id") == F.col("proposal_id"), "left")
    return rows.select("Id", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.coalesce("score", F.lit(100)).alias("score"))


@query(_SCORED + "select * from steps")
def affinity_deltas(spark, d):
    return affinity_steps(spark, d)


@query(_AFFINITY)
def party_affinity(spark, d):
    return _affinity(scoring.clamped_fold(affinity_steps(spark, d), ["UserId", "party"], ["vote_id", "block_id"], "tenths"))


@query(_AFFINITY)
def party_affinity_fold(spark, d):
    return _affinity(scoring.folded_in_array(affinity_steps(spark, d), ["UserId", "party"], ["vote_id", "block_id"], "tenths"))


@query(f"select UserId, max(affinity) as affinity from ({_WITH}{_AFFINITY}) t group by 1")
def best_affinity_per_user(spark, d):
    """The highest affinity of each user."""
    return party_affinity(spark, d).groupBy("UserId").agg(F.max("affinity").alias("affinity"))


@query(f"select UserId, party, affinity from (select *, row_number() over (partition by UserId order by affinity desc, party) as place from ({_WITH}{_AFFINITY}) t) where place = 1")
def best_party_per_user(spark, d):
    """The party of each user's highest affinity, the first in byte order among equals."""
    best = F.min(F.struct((-F.col("affinity")).alias("lost"), "party")).alias("best")
    return party_affinity(spark, d).groupBy("UserId").agg(best).select("UserId", "best.party", (-F.col("best.lost")).alias("affinity"))


# Weighted choice


def _candidates(spark, d):
    return filters.by_criteria(domain.proposals(spark, d, "Id", "Legislatura", "VoteDate", "Score"), **_CRITERIA | {"lowest_score": 0})


_CANDIDATES_SQL = _CRITERIA_SQL.replace("Score >= 1", "Score >= 0")


@query(f"select count(*) as n_candidates from laws where {_CANDIDATES_SQL}")
def candidate_count(spark, d):
    return _candidates(spark, d).agg(F.count("*").alias("n_candidates"))


@query(f"select coalesce(sum(Score), 0)::bigint as total_score from laws where {_CANDIDATES_SQL}")
def candidate_score_sum(spark, d):
    return _candidates(spark, d).agg(F.coalesce(F.sum("Score"), F.lit(0)).alias("total_score"))


@query("select Id, Score, (sum(Score) over (order by Id rows unbounded preceding))::bigint as running from laws")
def cumulative_score(spark, d):
    return picking.running_total(domain.proposals(spark, d, "Id", "Score"), "Id", "Score")


@query(f", running as (select Id, Score, (sum(Score) over (order by Id rows unbounded preceding))::bigint as running from laws where {_CANDIDATES_SQL}) select Id, Score, running from running where running >= (select floor(0.37 * sum(Score)) from running) order by Id limit 1")
def weighted_pick(spark, d):
    return picking.weighted_pick(_candidates(spark, d), "Id", "Score", 0.37).select("Id", "Score", "running")


@query()
def weighted_pick_unbiased(spark, d):
    return picking.weighted_pick_unbiased(_candidates(spark, d), "Id", "Score", 11).select("Id", "Score")


# Shapes that clients show


@query("select VotingResultId, count(*) filter (votingOrientation = 0) as n_for, count(*) filter (votingOrientation = 1) as n_against, count(*) filter (votingOrientation not in (0, 1)) as n_abstaining from parts where VotingResultId is not null group by 1")
def blocks_by_orientation(spark, d):
    side = F.when(F.col("votingOrientation") == 0, "n_for").when(F.col("votingOrientation") == 1, "n_against").otherwise("n_abstaining")
    return domain.blocks(spark, d).where("VotingResultId is not null").withColumn("side", side).groupBy("VotingResultId").pivot("side", ["n_for", "n_against", "n_abstaining"]).agg(F.count(F.lit(1))).na.fill(0)


@query("select Id, case when ProposalResult is null then null when ProposalResult = 2 then 'approved' else 'rejected' end as generality, case when ProposalResult is null then null when ProposalResult = 3 then 'approved' else 'rejected' end as speciality from laws")
def approval_label(spark, d):
    label = lambda code: F.when(F.col("ProposalResult").isNotNull(), F.when(F.col("ProposalResult") == code, "approved").otherwise("rejected"))
    return domain.proposals(spark, d).select("Id", label(2).alias("generality"), label(3).alias("speciality"))


@query("select l.Id, stage, count(b.Id) as n_blocks from (select Id, 'generality' as stage, VotingResultGeneralityId as rid from laws union all select Id, 'speciality', VotingResultSpecialityId from laws) l left join parts b on b.VotingResultId = rid group by 1, 2")
def stage_blocks(spark, d):
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("result_id")) for s, c in (("generality", "VotingResultGeneralityId"), ("speciality", "VotingResultSpecialityId"))])
    rows = domain.proposals(spark, d).select("Id", F.explode(stages).alias("s")).select("Id", "s.stage", "s.result_id")
    counts = domain.blocks(spark, d, "Id", "VotingResultId").where("VotingResultId is not null").groupBy(F.col("VotingResultId").alias("result_id")).agg(F.count("*").alias("n_blocks"))
    return rows.join(counts, "result_id", "left").select("Id", "stage", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


@query("select Id, case ProposalResult " + " ".join(f"when {k} then '{v}'" for k, v in PROPOSAL_RESULTS.items()) + " end as result, ProposalResult as code from laws")
def enum_names(spark, d):
    name = text.enum_name(F.col("ProposalResult"), PROPOSAL_RESULTS)
    return domain.proposals(spark, d).select("Id", name.alias("result"), text.enum_code(name, PROPOSAL_RESULTS).alias("code"))


@query("select Id, case when googleIDToken is not null then 'google' when facebookIDToken is not null then 'facebook' else 'email' end as kind, Id <> 0 as logged_in from people")
def user_type(spark, d):
    kind = F.when(F.col("googleIDToken").isNotNull(), "google").when(F.col("facebookIDToken").isNotNull(), "facebook").otherwise("email")
    return domain.users(spark, d).select("Id", kind.alias("kind"), (F.col("Id") != 0).alias("logged_in"))


@query("select partyAcronym, concat('lib/images/', partyAcronym, '_logo.png') as path from parties")
def logo_path(spark, d):
    return domain.parties(spark, d).select("partyAcronym", F.concat(F.lit("lib/images/"), "partyAcronym", F.lit("_logo.png")).alias("path"))


@query("select distinct Id, length(c) as n_chars, sha256(c) as hash from (select Id, regexp_replace(replace(replace(ProposalTextHTML, '<censored>', 'CENSURADO'), chr(10), ''), '<[^>]*>|&[^;]+;', '', 'g') as c from proposals)")
def clean_html(spark, d):
    cleaned = spread(read_table(spark, d, "proposals", "Id", "ProposalTextHTML"), "Id").select("Id", text.stripped_html(F.col("ProposalTextHTML")).alias("c"))
    return cleaned.select("Id", F.length("c").cast("bigint").alias("n_chars"), text.hashed(F.col("c")).alias("hash")).distinct()


@query("select Id, sha256(Password) as hash from people")
def password_hash(spark, d):
    return domain.users(spark, d).select("Id", text.hashed(F.col("Password")).alias("hash"))


@query("select Id, coalesce(regexp_matches(regexp_replace(Email, '^\\s+|\\s+$', '', 'g'), '" + text.EMAIL.replace("'", "''") + "'), false) as valid, case when contains(Email, '@') then 'email' else 'userName' end as kind from people")
def email_valid(spark, d):
    return domain.users(spark, d).select("Id", text.looks_like_email(text.trimmed(F.col("Email"))).alias("valid"), text.identifier_kind(F.col("Email")).alias("kind"))


@query("select row_number() over (order by partyAcronym) - 1 as place, * from parties")
def party_envelope(spark, d):
    """The rows within the envelope, with their places."""
    whole = records.enveloped(domain.parties(spark, d), "parties", F.col("partyAcronym"))
    return whole.select(F.posexplode("parties").alias("place", "p")).select(F.col("place").cast("bigint").alias("place"), "p.*")


# Changes of tables


@query("select Id, case when Id = 1003 then 'A new title' else ProposalTitle end as ProposalTitle, case when Id = 1003 then 77 else Score end as Score, ProposalResult from laws")
def patch_proposal(spark, d):
    patch = spark.sql("select 1003 as Id, 'A new title' as ProposalTitle, 77 as Score, cast(null as int) as ProposalResult")
    return mutations.patched(domain.proposals(spark, d), patch, "Id").select("Id", "ProposalTitle", "Score", "ProposalResult")


@query("select Id, VoteDate, ProjectLawID, VotingOrientation, UserId from ballots union all select (select max(Id) from ballots) + 1, timestamp '2024-01-02 12:00:00', 1003, 1, 7")
def append_vote(spark, d):
    """A vote that is kept without changing counters or statistics."""
    votes = domain.votes(spark, d)
    new = mutations.with_new_ids(spark.sql("select timestamp_ntz'2024-01-02 12:00:00' as VoteDate, 1003 as ProjectLawID, 1 as VotingOrientation, 7 as UserId"), votes, "Id", "ProjectLawID")
    return mutations.appended(votes, new)


@query("select Id, case when UserId = 7 then null else UserId end as UserId from ballots")
def delete_user_votes(spark, d):
    """The votes after their user was deleted: kept without user."""
    return mutations.detached(domain.votes(spark, d).select("Id", "UserId"), "UserId", 7)


@query("select Id, UserName from people where Id <> 7")
def delete_user(spark, d):
    return mutations.deleted(domain.users(spark, d, "Id", "UserName"), "Id", 7)


@query("select Id from laws where Id <> 1003")
def delete_proposal(spark, d):
    return mutations.deleted(domain.proposals(spark, d).select("Id"), "Id", 1003)


@query("select 'proposals' as table_name, Id::varchar as key from laws where ProposingPartypartyAcronym <> 'UVX' union all select 'party_stats', Id::varchar from party_stats where PoliticalPartypartyAcronym <> 'UVX' union all select 'parties', partyAcronym from parties where partyAcronym <> 'UVX'")
def delete_party_cascade(spark, d):
    """The keys that are left in the three tables after a party was deleted."""
    left = {
        "proposals": mutations.deleted(domain.proposals(spark, d, "Id", "ProposingPartypartyAcronym"), "ProposingPartypartyAcronym", "UVX").select(F.col("Id").cast("string").alias("key")),
        "party_stats": mutations.deleted(domain.stats(spark, d), "PoliticalPartypartyAcronym", "UVX").select(F.col("Id").cast("string").alias("key")),
        "parties": mutations.deleted(domain.parties(spark, d), "partyAcronym", "UVX").select(F.col("partyAcronym").alias("key")),
    }
    keys = [rows.select(F.lit(name).alias("table_name"), "key") for name, rows in left.items()]
    return keys[0].unionAll(keys[1]).unionAll(keys[2])


@query("select * from laws where false")
def delete_all(spark, d):
    return mutations.emptied(domain.proposals(spark, d))


_LOGINS = "(values (1, 'moinho.2@example.org', null, 'social'), (2, null, 'moinho_2', 'wrong'), (3, null, 'no such name', 'x'), (4, null, null, 'x')) t(request, Email, UserName, Password)"


@query(f"select request, u.Id, u.Password = t.Password as same_password from {_LOGINS} left join people u on case when t.Email is not null then u.Email = t.Email else u.UserName = t.UserName end")
def login_lookup(spark, d):
    """Requests with the user of their address or, without address, of their name."""
    asked = spark.createDataFrame([(1, "moinho.2@example.org", None, "social"), (2, None, "moinho_2", "wrong"), (3, None, "no such name", "x"), (4, None, None, "x")], "request int, Email string, UserName string, Password string")
    found = nesting.by_first_key(asked, domain.users(spark, d, "Id", "Email", "UserName", "Password"), ["Email", "UserName"], "user")
    return found.select("request", "user.Id", (F.col("user.Password") == F.col("Password")).alias("same_password"))


@query("select Id as id, ProposalTitle as title, FullProposalTextLink as \"fullTextUrl\", 0 as views from laws")
def migrated_proposals(spark, d):
    """Renamed, added and dropped columns."""
    return mutations.migrated(domain.proposals(spark, d), {"Id": "id", "ProposalTitle": "title", "FullProposalTextLink": "fullTextUrl"}, {"views": F.lit(0)}, [c for c in domain.PROPOSAL_COLUMNS if c not in ("Id", "ProposalTitle", "FullProposalTextLink")])


_SIGN_UPS = "(values (-1, 'moinho_2', 'new@example.org'), (-2, 'someone_new', 'moinho.2@example.org'), (-3, 'nobody_yet', 'nobody@example.org'), (-4, 'moinho_2', 'moinho.2@example.org')) t(Id, UserName, Email)"


def _sign_ups(spark):
    return spark.createDataFrame([(-1, "moinho_2", "new@example.org"), (-2, "someone_new", "moinho.2@example.org"), (-3, "nobody_yet", "nobody@example.org"), (-4, "moinho_2", "moinho.2@example.org")], "Id int, UserName string, Email string")


@query(f"select *, case when Email in (select Email from people) then 'Email' else 'UserName' end as conflict from {_SIGN_UPS} where Email in (select Email from people) or UserName in (select UserName from people)")
def signup_conflicts(spark, d):
    """New rows whose address or name is taken; the address is tested first."""
    return mutations.rejected(_sign_ups(spark), domain.users(spark, d, "UserName", "Email"), "Email", "UserName")


@query("select Id, UserName from people where googleIDToken = 'gtok-2' union all select null, 'newcomer' where 'gtok--1' not in (select googleIDToken from people where googleIDToken is not null) union all select null, 'known' where 'gtok-2' not in (select googleIDToken from people where googleIDToken is not null)")
def social_get_or_create(spark, d):
    wanted = spark.createDataFrame([("gtok-2", "known"), ("gtok--1", "newcomer")], "googleIDToken string, UserName string")
    return mutations.get_or_create(domain.users(spark, d), wanted, "googleIDToken").select("Id", "UserName")
