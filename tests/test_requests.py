from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hemicycle import schemas
from hemicycle.operators import mutations, nesting, picking, requests
from hemicycle.sources import records

AT = datetime(2024, 1, 2)


def tables(spark, stats=(), blocks=((1, 50, "A", 0), (2, 50, "B", 1), (3, 50, "A", 1), (4, 50, "Z", 0), (5, None, "A", 0)), counters=(0, 0)):
    interested, total = counters
    law = lambda i, result, party: (i, i, "XV", 100, interested, total, "2023-01-01", party, "t", f"link{i}", None, None, result, None)
    return requests.Tables(
        spark.createDataFrame([(7, AT, 10, 0, 1)], schemas.VOTES),
        spark.createDataFrame([law(10, 50, "A"), law(11, None, "B"), law(12, 99, "B")], schemas.PROPOSALS),
        spark.createDataFrame([(1,), (2,)], "Id int"),
        spark.createDataFrame(list(stats), schemas.PARTY_STATS),
        spark.createDataFrame([(50, False)], schemas.VOTING_RESULTS),
        spark.createDataFrame([(i, r, None, None, p, o) for i, r, p, o in blocks], schemas.VOTING_BLOCKS),
        spark.createDataFrame([("A", "a", ""), ("B", "b", "")], schemas.PARTIES),
    )


def cast(spark, asked, **more):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "request int, userID int, projectLawID int, votingOrientation string")
    return {k: v.collect() for k, v in requests.cast_votes(tables(spark, **more), df, F.lit("2024-02-03 00:00:00")).items()}


def stepwise(stats, asked, blocks):
    """The statistics after one vote after another, block after block."""
    codes = {"InFavor": 0, "Against": 1, "Abstaining": 2, "NotInterested": 3}
    out = dict(stats)
    for user, orientation in asked:
        for party, code in blocks:
            n, points = out.get((user, party), (0, 0.0))
            step = (1 if code == codes[orientation] else -0.2) if party == "A" else (0.9 if code == codes[orientation] else -0.1)
            out[user, party] = (n + 1, max(points + step, 0.0))
    return out


def test_votes_change_counters_and_statistics(spark):
    stats = [(1, "A", 10.0, 5, 0.3, 1), (2, "A", 0.0, 9, 9.0, 1), (3, "B", 0.0, 1, 2.0, 2), (4, "A", 0.0, 1, 1.0, None)]
    asked = [(1, 10, "Abstaining"), (2, 10, "InFavor"), (1, 10, "NotInterested"), (1, 10, "Against")]
    out = cast(spark, asked, stats=stats, counters=(3, 3))
    assert [(r.Id, r.UserId, r.VotingOrientation, r.VoteDate) for r in sorted(out["votes"])[1:]] == [(8 + i, u, o, datetime(2024, 2, 3)) for i, (u, o) in enumerate([(1, 2), (2, 0), (1, 3), (1, 1)])]
    assert {r.Id: (r.totalAmountOfVotesFromUsers, r.amountOfUsersInterested, r.Score) for r in out["proposals"]} == {10: (7, 6, 0), 11: (3, 3, 100), 12: (3, 3, 100)}
    expected = stepwise({(1, "A"): (5, 0.3), (2, "B"): (1, 2.0)}, [(u, o) for u, _, o in asked], [("A", 0), ("B", 1), ("A", 1)])
    got = {(r.UserId, r.PoliticalPartypartyAcronym): r for r in out["stats"] if r.Id not in (2, 4)}
    assert set(got) == set(expected)
    for k, (n, points) in expected.items():
        assert got[k].totalAmountOfProposalsVotedOn == n and got[k].totalAffectionPoints == pytest.approx(points) and got[k].PartyAffectionScore == pytest.approx(points / n * 100)
    assert {r.Id for r in out["stats"]} == {1, 2, 3, 4, 5, 6}
    assert next(r for r in out["stats"] if r.Id == 2).totalAffectionPoints == 9.0  # the user's second row for the party


def test_votes_that_are_refused_change_nothing(spark):
    out = cast(spark, [(1, 11, "InFavor"), (1, 12, "InFavor"), (1, 99, "InFavor"), (5, 10, "InFavor"), (None, 10, "InFavor"), (1, None, "InFavor"), (1, 10, "in favor"), (1, 10, None)])
    assert [r.outcome for r in sorted(out["outcomes"])] == [requests.NO_RESULT, requests.NO_RESULT, requests.NO_PROPOSAL, requests.NO_USER, requests.NO_USER, requests.NO_PROPOSAL, requests.NO_ORIENTATION, requests.NO_ORIENTATION]
    assert len(out["votes"]) == 1 and not out["stats"] and {r.totalAmountOfVotesFromUsers for r in out["proposals"]} == {0}
    assert len(cast(spark, [])["votes"]) == 1


def test_proposals_are_created_in_order(spark):
    t = tables(spark)
    result = {"isUninamous": True, "votingBlocks": [{"politicalPartyAcronym": "A", "votingOrientation": "Against"}, {"politicalPartyAcronym": "?", "votingOrientation": "odd"}]}
    rows = [{"request": i, **r} for i, r in enumerate([{"fullProposalTextLink": "link10", "sourceId": 1}, {"fullProposalTextLink": "new"}, {"fullProposalTextLink": "other", "sourceId": 2, "proposingPartyAcronym": "A", "proposalResult": "ApprovedInSpeciality", "votingResultSpeciality": result}, {"fullProposalTextLink": "new", "sourceId": 3}, {"sourceId": 4}, {"sourceId": 5}])]
    schema = "request int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PROPOSAL_REQUEST)
    out = {k: sorted(v.collect()) for k, v in requests.create_proposals(t.proposals, t.parties, t.results, t.blocks, spark.createDataFrame(rows, schema)).items()}
    assert [r.outcome for r in out["outcomes"]] == [requests.PROPOSAL_EXISTS, requests.NO_SOURCE, None, requests.PROPOSAL_EXISTS, None, None]
    assert [(r.Id, r.SourceId, r.Score, r.ProposingPartypartyAcronym, r.ProposalResult, r.VotingResultSpecialityId) for r in out["proposals"]] == [(13, 2, 100, "A", 3, 51), (14, 4, 100, None, None, None), (15, 5, 100, None, None, None)]
    assert [(r.Id, r.VotingResultId, r.votingOrientation) for r in out["blocks"]] == [(6, 51, 1), (7, 51, None)]


def test_users_and_parties_are_created(spark):
    users = spark.createDataFrame([(4, "ann", "a@x.org", "", 0, None, None)], schemas.USERS)
    parties = tables(spark).parties
    asked = spark.createDataFrame([(0, "ann", "a@x.org", "p", 1), (1, "ann", "b@x.org", "p", 1), (2, "bob", "b@x.org", "p", 1), (3, "bob", "c@x.org", "p", 1), (4, None, None, "p", 1)], "request int, userName string, email string, password string, profilePic int")
    out = {k: sorted(v.collect(), key=str) for k, v in requests.create_users(users, spark.createDataFrame([], schemas.PARTY_STATS), parties, asked).items()}
    assert {r.request: r.outcome for r in out["outcomes"]} == {0: requests.EMAIL_EXISTS, 1: requests.NAME_EXISTS, 2: requests.EMAIL_EXISTS, 3: requests.NAME_EXISTS, 4: None}
    assert [(r.Id, r.UserName) for r in out["users"]] == [(5, None)] and {(r.Id, r.UserId, r.PoliticalPartypartyAcronym) for r in out["stats"]} == {(1, 5, "A"), (2, 5, "B")}


def test_single_and_last_row(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (3, "c"), (3, "c")], "Id int, x string")
    assert [r.x for r in picking.last_row(df, "Id").collect()] == ["c"] and picking.last_row(df.where("false"), "Id").count() == 0
    assert [tuple(r) for r in picking.single_or_default(df.where("Id = 2")).collect()] == [(2, "b")]
    assert [tuple(r) for r in picking.single_or_default(df.where("false")).collect()] == [(None, None)]
    with pytest.raises(Exception, match="more than one row"):
        picking.single_or_default(df).collect()


def test_seeds_and_types(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "k string, n int")
    assert {tuple(r) for r in mutations.reseeded(df, "k", new, spark.createDataFrame([("a", 7)], "k string, n int"), ["b"]).collect()} == {("a", 7), (None, 3), ("c", 4)}
    assert mutations.migrated(df, {"n": "m"}, {}, retyped={"n": "string"}).dtypes == [("k", "string"), ("m", "string")]


def test_client_records(spark):
    bodies = spark.createDataFrame([('{"id": 1, "proposalTitle": "T", "proposalTextHTML": "<p>a\\n&amp;<censored></p>", "proposalResult": "RejectedInSpeciality", "votingResultGenerality": {"isUninamous": true, "votingBlocks": [{"numberOfDeputies": 3, "votingOrientation": "Abstaining"}]}}',), ('{"id": 2}',), ("{",), (None,)], "b string")
    one, two, *broken = records.client_proposal(records.parsed(bodies, "b", records.PROPOSAL_RECORD)).collect()
    assert (one.title, one.censoredText, one.votingResult, one.votingResultInGenerality.votingBlocks[0].voteOrientation) == ("T", "aCENSURADO", 1, 2)
    assert two.id == 2 and two.proposingParty is None and two.votingResultInSpeciality is None and {r.id for r in broken} == {None}
    users = spark.createDataFrame([('{"id": 3, "userName": "n", "facebookIDToken": "f", "votes": [{"projectLawID": 5, "votingOrientation": "Against"}]}',), ('{"id": 0}',)], "b string")
    user, empty = records.client_user(records.parsed(users, "b", records.USER_RECORD)).collect()
    assert (user.userType, user.isLoggedIn, user.userVotes[0].proposalID, user.userVotes[0].voteOrientation, user.partyStats) == ("facebook", True, 5, 1, [])
    assert (empty.userType, empty.isLoggedIn, empty.userVotes) == ("email", False, [])


def test_users_of_memory_in_their_envelope(spark):
    """Two users without votes and statistics: an envelope of two, with empty arrays."""
    users = spark.createDataFrame([(1, "user_one", "one@example.org", "pw1", 1, None, None), (2, "user_two", "two@example.org", "pw2", 2, None, None)], schemas.USERS)
    t = tables(spark)
    rows = nesting.with_children(users, "Id", t.votes.select("UserId", F.col("Id").alias("VoteId")).where("UserId < 0"), "UserId", "votes")
    rows = nesting.with_children(rows, "Id", nesting.with_parent(t.stats, "PoliticalPartypartyAcronym", t.parties, "partyAcronym", "party", "inner"), "UserId", "partyStats")
    (whole,) = records.enveloped(rows, "users", "Id").collect()
    assert [(u.Id, u.UserName, u.votes, u.partyStats) for u in whole.users] == [(1, "user_one", [], []), (2, "user_two", [], [])]
