import pytest
from pyspark.sql import functions as F

from hemicycle.llm import mixing

DOCS = "doc long, source string, n_tokens long, weight double, running int, mix_id string"
TARGETS = "mix_id string, size_factor double, source string, target_weight double, max_repeats int, weight int"


def documents(spark, rows):
    return spark.createDataFrame([(i, s, n, w, 0, "q") for i, (s, n, w) in enumerate(rows)], DOCS)


def reports(spark, rows, targets, **more):
    selection, plan = mixing.mix(documents(spark, rows), spark.createDataFrame([(*t, 3) for t in targets], TARGETS), "doc", **more)
    return selection.collect(), {(r.mix_id, r.source): r for r in mixing.mix_report(selection, plan).collect()}


@pytest.mark.parametrize("bucket_rows", [1, 20, 100_000])
def test_targets_are_met_by_epochs_and_a_fraction(spark, bucket_rows):
    rows = [("Big", 10, 1.0)] * 300 + [(" small\t", 7, 0.5)] * 20 + [("BIG ", 10, 0.2)] * 100 + [(None, 50, 1.0)] * 4 + [("other", 0, 1.0)]
    targets = [("m", 0.5, "big", 3.0, None), ("m", 0.5, "small", 1.0, 6), ("n", 1.0, "small", 9.0, 2), ("n", 1.0, "big", 1.0, 1), ("n", 1.0, "none", 1.0, 4), ("n", 1.0, "other", 0.0, 4)]
    selection, report = reports(spark, rows, targets, bucket_rows=bucket_rows)
    total = sum(n for _, n, _ in rows)
    assert report["m", "big"].target_tokens == pytest.approx(total * 0.5 * 0.75)
    for key in (("m", "big"), ("m", "small"), ("n", "big")):
        assert report[key].reachable and abs(report[key].reached_tokens - report[key].target_tokens) <= 5
    assert not report["n", "small"].reachable and report["n", "small"].reached_tokens == 280 and report["n", "small"].most_uses == 2
    assert not report["n", "none"].reachable and report["n", "none"].reached_tokens == 0
    assert report["n", "other"].reachable
    assert sum(r.actual_share for r in report.values() if r.mix_id == "m") == pytest.approx(1)
    uses = {r.doc: r.n_uses for r in selection if (r.mix_id, r.source) == ("m", "small")}
    assert len(uses) == 20 and set(uses.values()) <= {4, 5, 3}


def test_weights_bias_the_fraction_and_runs_repeat(spark):
    rows = [("a", 1, 1.0)] * 1000 + [("a", 1, 0.1)] * 1000
    first, _ = reports(spark, rows, [("m", 0.25, "a", 1.0, 1)])
    again, _ = reports(spark, rows, [("m", 0.25, "a", 1.0, 1)])
    assert {r.doc for r in first} == {r.doc for r in again} and len(first) == 500
    heavy = sum(r.doc < 1000 for r in first)
    assert heavy > 400
    other, _ = reports(spark, rows, [("m", 0.25, "a", 1.0, 1)], seed=8)
    assert {r.doc for r in other} != {r.doc for r in first}


def test_running_sums_do_not_depend_on_buckets(spark):
    df = documents(spark, [("a", i % 7, 1.0 + i % 3) for i in range(200)]).withColumn("source_key", F.col("source"))
    sums = lambda b: {r.doc: r.running for r in mixing.running_tokens(df, mixing.source_sizes(df), "doc", 3, b).collect()}
    assert sums(1) == sums(64) and max(sums(1).values()) == sum(i % 7 for i in range(200))


@pytest.mark.parametrize("weight", ["1.0", "0.5", "0.05", "if(doc % 3 = 0, 0.05, 1.0)", "0.05 + doc % 100 / 100"])
def test_no_bucket_holds_much_more_than_meant(spark, weight):
    n, rows = 200_000, 2_000
    df = spark.range(n).selectExpr("id as doc", f"{weight} as weight").select(mixing.bucket_of(mixing.exponential_key("doc", F.col("weight"), 5), F.lit(n), rows).alias("b"))
    sizes = [r["count"] for r in df.groupBy("b").count().collect()]
    assert max(sizes) < 1.25 * rows and len(sizes) > n / rows


def test_what_is_unreachable_follows_from_the_selection(spark):
    rows = [("a", 10, 1.0)] * 10 + [("b", 10, 1.0)] * 90
    _, report = reports(spark, rows, [("exact", 0.2, "a", 1.0, 2), ("above", 0.2001, "a", 1.0, 2), ("below", 0.199, "a", 1.0, 2), ("never", 0.1, "a", 1.0, 0), ("nothing", 0.1, "z", 1.0, 3), ("zero", 0.0, "a", 1.0, 1)])
    got = {m: r.reachable for (m, _), r in report.items()}
    assert got == {"exact": True, "above": False, "below": True, "never": False, "nothing": False, "zero": True}
    assert report["above", "a"].reached_tokens == 200 and report["above", "a"].least_uses == report["above", "a"].most_uses == 2


def test_nulls_and_empty_tables(spark):
    assert reports(spark, [], []) == ([], {})
    selection, report = reports(spark, [], [("m", 1.0, "a", 1.0, 1)])
    assert selection == [] and report["m", "a"].reachable
    selection, report = reports(spark, [("a", None, 1.0), ("a", 4, 1.0)], [("m", None, "a", 1.0, None), ("z", 1.0, "a", None, 3), ("z", 1.0, None, 1.0, 3), ("r", 1.0, "a", 1.0, 2), ("r", 1.0, "a", 1.0, 2)])
    assert report["m", "a"].reached_tokens == report["z", "a"].reached_tokens == 0
    assert not report["z", None].reachable
    assert report["r", "a"].reached_tokens == 4
