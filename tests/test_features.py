from datetime import datetime

from pyspark.sql import functions as F

from hemicycle.operators import features

EVENTS = "id int, entity int, at timestamp_ntz, kind string, event_type string, salt int"
T = datetime(2023, 9, 1, 12)


def test_first_deliveries(spark):
    rows = [(1, 5, datetime(2023, 1, 2), "a", "x", 0), (1, 5, datetime(2023, 1, 1), "b", "x", 0), (1, 5, None, "c", "x", 0), (2, 5, None, "d", "x", 0), (3, 6, T, "z", "x", 0), (3, 6, T, "y", "x", 0)]
    out = features.first_deliveries(spark.createDataFrame(rows, EVENTS), "id", "at")
    assert {(r.id, r.kind) for r in out.collect()} == {(1, "a"), (2, "d"), (3, "y")}
    assert {(r.id, r["at"]) for r in out.collect()} == {(1, datetime(2023, 1, 1)), (2, None), (3, T)}
    assert out.columns == ["id", "entity", "at", "kind", "event_type", "salt"]


def test_heavy_keys_and_salts_change_no_result(spark):
    rows = [(i, 7 if i % 3 else i % 50, T, "ab"[i % 2], "x", 9) for i in range(600)] + [(1000 + i, None, T, "a", "x", 9) for i in range(300)]
    events = spark.createDataFrame(rows, EVENTS)
    assert features.heavy_keys(events, "entity", "kind", share=4) == [[7], ["a", "b"]] and features.heavy_keys(events, "kind", "entity", share=2) == [["a"], []]
    assert features.heavy_keys(events, "entity", share=1) == [[]] and features.heavy_keys(events.where("false"), "entity", "kind") == [[], []]
    names = spark.createDataFrame([(i, f"n{i}", 1) for i in range(0, 40)], "entity int, name string, _salts int")
    plain = sorted(map(tuple, features.join_hot(events, names, "entity", [], "id").collect()), key=str)
    assert sorted(map(tuple, features.join_hot(events, names, "entity", [7], "id").collect()), key=str) == plain and len(plain) > 400
    known = spark.createDataFrame([(i,) for i in (7, 7, 3, 4, 999)], "entity int")
    for of in (None, known):
        one = {tuple(r) for r in features.event_statistics(events, "entity", F.col("kind"), "at", "id", of).collect()}
        assert {tuple(r) for r in features.event_statistics(events, "entity", F.col("kind"), "at", "id", of, hot=[7, 3]).collect()} == one and one


def test_plan_of_light_groups_has_one_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats = features.event_statistics(spark.createDataFrame([(1, 1, T, "a", "x", 9)], EVENTS), "entity", F.col("kind"), "at", "id", spark.createDataFrame([(1,)], "entity int"))
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(entity") == 1 and plan.count("Exchange") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_statistics_and_features(spark):
    rows = [(i, 1, T, "a", "x", 9) for i in range(50)] + [(100, 1, datetime(2023, 9, 30, 1), "b", "x", 9), (101, 2, None, "a", "x", 9), (102, None, T, "a", "x", 9), (103, 2, T, None, "x", 9)]
    stats = features.event_statistics(spark.createDataFrame(rows, EVENTS), "entity", F.col("kind"), "at", "id")
    assert {(r.entity, r.event_type, r.n_events) for r in stats.collect()} == {(1, "a", 50), (1, "b", 1), (2, "a", 1)}
    entities = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "entity int")
    types = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "event_type string")
    table = {r.entity: r for r in features.feature_table(stats, entities, "entity", types, "2023-10-01 00:00:00").collect()}
    assert set(table) == {1, 2, 3}
    assert [tuple(f) for f in table[1].features] == [("a", 50, 29, 50 / 51), ("b", 1, 0, 1 / 51), ("c", 0, None, 0.0)]
    assert [tuple(f) for f in table[2].features] == [("a", 1, None, 1.0), ("b", 0, None, 0.0), ("c", 0, None, 0.0)]
    assert table[3].n_events == 0
    few = features.feature_table(stats, entities, "entity", types.where("event_type = 'b'"), "2023-10-01 00:00:00").where("entity = 1").first()
    assert few.n_events == 51 and [tuple(f) for f in few.features] == [("b", 1, 0, 1 / 51)]


def test_empty_tables(spark):
    stats = features.event_statistics(spark.createDataFrame([], EVENTS), "entity", F.col("kind"), "at", "id")
    assert stats.count() == 0
    types, entities = spark.createDataFrame([], "event_type string"), spark.createDataFrame([(4,)], "entity int")
    assert [(r.entity, r.n_events, r.features) for r in features.feature_table(stats, entities, "entity", types, "2023-10-01").collect()] == [(4, 0, [])]


def test_days_are_whole(spark):
    rows = spark.createDataFrame([(datetime(2023, 9, 30, 0, 0, 0),), (datetime(2023, 9, 30, 0, 0, 0, 1),), (datetime(2023, 9, 29, 23, 59),)], "t timestamp_ntz")
    assert [r.d for r in rows.select(features.days_before(F.col("t"), "2023-10-01 00:00:00").alias("d")).collect()] == [1, 0, 1]


def test_hot_key_is_spread_over_tasks(spark):
    """With joins by shuffle, the largest part of a join with a key of a third of all rows holds no such share."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        events = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 1, id % 1000) as key")
        names = spark.range(1000).selectExpr("id as key", "id as name")
        (hot,) = features.heavy_keys(events, "key", share=20)
        parts = [r["count"] for r in features.join_hot(events, names, "key", hot, "id").groupBy(F.spark_partition_id()).count().collect()]
        assert hot == [1] and sum(parts) == 9000 and max(parts) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
