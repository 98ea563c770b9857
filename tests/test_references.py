import random
from datetime import datetime, timedelta

import pytest

from hemicycle.operators.references import Reference, orphan_references, orphan_report

VOTES = "Id int, VoteDate timestamp_ntz, ProjectLawID int, UserId int, key string, period int, salt int"
LOG = "entity string, entity_id int, operation string, logged_at timestamp_ntz, key int"


def brute(votes, laws, users, log):
    first = {}
    for v in votes:
        if v[0] not in first or (v[1] is not None and (first[v[0]][1] is None or v[1] < first[v[0]][1])):
            first[v[0]] = v
    out = set()
    for i, at, law, user, *_ in first.values():
        for field, key, there, entity in (("ProjectLawID", law, laws, "proposal"), ("UserId", user, users, "user")):
            if key is None:
                continue
            created = [t for e, k, o, t in log if e == entity and k == key and o == "created" and t is not None]
            removed = any(e == entity and k == key and o == "removed" for e, k, o, _ in log)
            if key not in there:
                out.add((i, field, "deleted" if removed else "missing"))
            elif created and at is not None and min(created) > at:
                out.add((i, field, "late"))
    return out


def tables(spark, votes, laws, users, log):
    refs = [
        Reference("ProjectLawID", spark.createDataFrame([(x,) for x in laws], "Id int"), "Id", "proposals", "proposal"),
        Reference("UserId", spark.createDataFrame([(x,) for x in users], "Id int"), "Id", "users", "user"),
    ]
    return spark.createDataFrame([(*v, "x", 1, 2) for v in votes], VOTES), refs, spark.createDataFrame([(*x, 5) for x in log], LOG)


def found(spark, *args):
    votes, refs, log = tables(spark, *args)
    return {(r.record_id, r.ref_field, r.reason) for r in orphan_references(votes, refs, log).collect()}


@pytest.mark.parametrize("most", [0, 200_000])
def test_random_tables_match_brute_force(spark, monkeypatch, most):
    """Surviving bitmaps that are shuffled, and broadcast."""
    monkeypatch.setattr("hemicycle.operators.references.BROADCAST_RANGES", most)
    rng = random.Random(5)
    start = datetime(2021, 1, 1)
    at = lambda: start + timedelta(hours=rng.randrange(24 * 120))
    keys = [-130, -64, -1, 0, 1, 62, 63, 64, 127, 128, 2**31 - 1]
    votes = [(i, at(), rng.choice(keys), rng.choice([*keys, None])) for i in range(300)]
    votes += [(i, d + timedelta(days=40), p, u) for i, d, p, u in rng.sample(votes, 60)]
    laws, users = [0, 63, 64, -1, 63, None], [1, 62, -64, 2**31 - 1]
    log = [(rng.choice(["proposal", "user"]), rng.choice(keys), rng.choice(["created", "removed", "other"]), at()) for _ in range(40)]
    args = (votes, laws, users, log)
    assert found(spark, *args) == brute(*args)


def test_keys_that_are_no_integers(spark):
    """Texts are numbered by a dictionary; spellings that differ are different keys."""
    rng = random.Random(8)
    start = datetime(2021, 1, 1)
    at = lambda: start + timedelta(hours=rng.randrange(24 * 90))
    keys = ["a", "b", "", " a", "00", "0", "Ã", "x" * 3000]
    votes = [(i, at(), keys[0] if rng.random() < 0.4 else rng.choice(keys), rng.choice([*keys, None])) for i in range(200)]
    laws, users = ["b", "0", None], ["a", "00"]
    log = [(rng.choice(["proposal", "user"]), rng.choice(keys), rng.choice(["created", "removed"]), at()) for _ in range(30)]
    refs = [Reference("law", spark.createDataFrame([(x,) for x in laws], "Id string"), "Id", "proposals", "proposal"), Reference("user", spark.createDataFrame([(x,) for x in users], "Id string"), "Id", "users", "user")]
    df = spark.createDataFrame([(*v, 1) for v in votes], "Id int, VoteDate timestamp_ntz, law string, user string, code int")
    got = orphan_references(df, refs, spark.createDataFrame(log, "entity string, entity_id string, operation string, logged_at timestamp_ntz"))
    rows = got.collect()
    names = {"ProjectLawID": "law", "UserId": "user"}
    assert {(r.record_id, r.ref_field, r.reason) for r in rows} == {(i, names[f], why) for i, f, why in brute(votes, laws, users, log)}
    assert all(r.key == votes[r.record_id][2 if r.ref_field == "law" else 3] for r in rows)


def test_times_within_one_month_are_compared(spark):
    t = datetime(2021, 5, 10)
    votes = [(1, t, 7, None), (2, t + timedelta(days=2), 7, None), (3, None, 7, None), (4, t + timedelta(days=1), 7, None)]
    assert found(spark, votes, [7], [], [("proposal", 7, "created", t + timedelta(days=1))]) == {(1, "ProjectLawID", "late")}


def test_nulls_and_empty_tables(spark):
    t = datetime(2021, 5, 10)
    assert found(spark, [], [], [], []) == set()
    assert found(spark, [(1, t, None, None)], [], [], []) == set()
    assert found(spark, [(1, None, 5, None), (None, t, 5, None)], [None], [], [("proposal", 5, "removed", None), ("proposal", None, "removed", t)]) == {(1, "ProjectLawID", "deleted"), (None, "ProjectLawID", "deleted")}


def test_repeated_rows_are_one_record(spark):
    t = datetime(2021, 5, 10)
    votes, refs, log = tables(spark, [(1, t, 5, 9)] * 3, [], [], [])
    orphans = orphan_references(votes, refs, log)
    assert orphans.count() == 2
    report = {(r.table_name, r.month, r.reason, r.n_references, r.n_keys) for r in orphan_report(orphans, refs).collect()}
    assert report == {("proposals", "2021-05", "missing", 1, 1), ("users", "2021-05", "missing", 1, 1)}
