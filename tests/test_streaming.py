import os
from datetime import datetime

import pytest

from hemicycle.operators.scoring import clamped_fold
from hemicycle.plans import catalogue, streams
from hemicycle.session import materialise, numbered, released
from hemicycle.streaming import affinity


def test_streams_equal_batches(spark, data_dir):
    counted = {tuple(r) for r in streams.vote_counters_streaming(spark, data_dir).collect()}
    assert counted == {tuple(r) for r in catalogue.proposal_vote_counters(spark, data_dir).collect()}
    streamed = {tuple(r) for r in streams.affinity_streaming(spark, data_dir).collect()}
    batch = clamped_fold(catalogue.affinity_steps(spark, data_dir), ["UserId", "party"], ["vote_id", "block_id"], "tenths")
    assert streamed == {tuple(r) for r in batch.collect()} and streamed


@pytest.fixture
def many_files(spark, data_dir, tmp_path):
    """The small tables with votes in seven files that overlap in ids, and some votes in two files."""
    for name in os.listdir(data_dir):
        if name != "votes.parquet":
            os.symlink(f"{data_dir}/{name}", tmp_path / name)
    votes = spark.read.parquet(f"{data_dir}/votes.parquet")
    votes.union(votes.where("Id % 11 = 0")).repartition(7).write.parquet(str(tmp_path / "votes.parquet"))
    return str(tmp_path)


def test_affinity_of_many_files_is_in_the_order_of_ids(spark, many_files):
    batch = clamped_fold(catalogue.affinity_steps(spark, many_files), ["UserId", "party"], ["vote_id", "block_id"], "tenths")
    streamed = streams.affinity_streaming(spark, many_files)
    assert {tuple(r) for r in streamed.collect()} == {tuple(r) for r in batch.collect()}


def test_counters_of_many_files_are_one_batch(spark, many_files, tmp_path, monkeypatch):
    """All files of the stored votes are counted at once, with known ids on disk; settings of the session stay as they were."""
    kept = str(tmp_path / "kept")
    monkeypatch.setattr(affinity, "_folder", lambda *_: kept)
    counted = {tuple(r) for r in streams.vote_counters_streaming(spark, many_files).collect()}
    assert counted == {tuple(r) for r in catalogue.proposal_vote_counters(spark, many_files).collect()}
    assert [x for x in os.listdir(f"{kept}/checkpoint/commits") if x.isdigit()] == ["0"]
    with open(f"{kept}/checkpoint/offsets/0") as offsets:
        assert "RocksDBStateStoreProvider" in offsets.read()
    assert all(spark.conf.get(k, None) is None for k in affinity.STATE_STORE)


def test_steps_by_user_are_the_steps(spark, data_dir):
    plain, by_user = catalogue.affinity_steps(spark, data_dir), catalogue.affinity_steps_by_user(spark, data_dir)
    columns = ["UserId", "vote_id", "block_id", "party", "tenths"]
    assert plain.select(columns).dtypes == by_user.select(columns).dtypes
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, by_user.select(columns).collect()))


SCHEMA = "Id int, VoteDate timestamp_ntz, ProjectLawID int, VotingOrientation int, UserId int"
VOTES = [(i, datetime(2021, 1, 1), i % 5, (7 * i) % 4, i % 3) for i in range(40)]


def steps(votes):
    return votes.selectExpr("UserId", "'x' as party", "Id as vote_id", "1 as block_id", "case VotingOrientation when 0 then 10 when 1 then -7 else -1 end as tenths")


def folded(votes):
    out = {}
    for _, _, _, o, u in votes:
        n, total = out.get(u, (0, 0))
        out[u] = (n + 1, max(0, total + {0: 10, 1: -7}.get(o, -1)))
    return out


@pytest.mark.parametrize(("merge_every", "delay"), [(1, None), (2, None), (3, "10 days"), (16, None)])
def test_state_is_kept_over_batches_and_runs(spark, tmp_path, merge_every, delay):
    """Two batches, a stop, and further batches in new queries on the same folder."""
    source, folder = str(tmp_path / "votes"), str(tmp_path / "state")
    run = lambda: {u: (n, t) for u, _, n, t in affinity.streaming_affinity(affinity.vote_stream(spark, source, "*.parquet"), steps, folder=folder, delay=delay, merge_every=merge_every).collect()}
    for parts, seen in (([0, 1], 20), ([2], 30), ([3, 3], 40)):
        for k in parts:
            spark.createDataFrame(VOTES[k * 10 : k * 10 + 10] + VOTES[:2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        assert run() == folded(VOTES[:seen])
    assert run() == folded(VOTES)
    kept = len(numbered(spark, f"{folder}/merged")) + len(numbered(spark, f"{folder}/changes"))
    assert kept <= 2 * merge_every + 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    one = spark.createDataFrame([(1, "x", 1, 1, 10), (1, "x", 2, 1, -30), (1, "x", 3, 1, 5)], "UserId int, party string, vote_id int, block_id int, tenths int")
    for _ in range(2):
        affinity.fold_batch(affinity.stored_state(spark, folder, 0), one).write.mode("overwrite").parquet(f"{folder}/changes/0")
        affinity.fold_batch(affinity.stored_state(spark, folder, 1), one.where("vote_id = 3")).write.mode("overwrite").parquet(f"{folder}/changes/1")
    assert [tuple(r) for r in affinity.stored_state(spark, folder).collect()] == [(1, "x", 4, 10)]


def test_counters_go_on(spark, tmp_path):
    source, folder = str(tmp_path / "votes"), str(tmp_path / "counters")
    for k in range(3):
        spark.createDataFrame(VOTES[k * 10 : k * 10 + 10] + VOTES[:2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        rows = affinity.run_available(affinity.streaming_counters(affinity.vote_stream(spark, source, "*.parquet")), "counters", folder).collect()
        assert sum(r.n_votes for r in rows) == 10 * k + 10
    assert len(numbered(spark, f"{folder}/result")) == 1


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "Id int, VoteDate timestamp_ntz, ProjectLawID int, VotingOrientation int, UserId int").write.parquet(str(tmp_path / "v"))
    assert affinity.run_available(affinity.streaming_counters(affinity.vote_stream(spark, str(tmp_path / "v"), "*.parquet")), "none").count() == 0


def test_materialised_tables_are_released(spark):
    with released():
        df = materialise(spark.range(3), "released")
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.isdir(path)
