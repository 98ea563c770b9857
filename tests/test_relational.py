import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from hemicycle.functions import keys, text
from hemicycle.operators import filters, mutations, nesting, picking, scoring
from hemicycle.sources import records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clamped_fold_is_the_loop(spark):
    rng = random.Random(3)
    steps = [(g, rng.randrange(0, 300_000), b, rng.choice([10, -2, 9, -1, -7, None])) for g in range(6) for b in range(rng.choice([1, 7, 60]))]
    expected = {}
    for g, _, _, v in sorted(steps, key=lambda s: (s[0], s[1], s[2], s[3] or 0)):
        n, total = expected.get(g, (0, 0))
        expected[g] = (n + 1, max(total + (v or 0), 0))
    df = spark.createDataFrame(steps, "g int, vote int, block int, v int")
    for stretch in (1, 1000, 1 << 30):
        assert {r.g: (r.n_steps, r.total) for r in scoring.clamped_fold(df, ["g"], ["vote", "block"], "v", stretch).collect()} == expected
    assert {r.g: (r.n_steps, r.total) for r in scoring.folded_in_array(df, ["g"], ["vote", "block"], "v").collect()} == expected
    assert scoring.clamped_fold(df.where("false"), ["g"], ["vote", "block"], "v").count() == 0


def test_counters(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (2, 1), (2, 2), (None, 1), (3, None)], "p int, o int")
    assert rows(scoring.vote_counters(df, "p", "o")) == [(1, 2, 1, 0), (2, 2, 2, 100), (3, 1, 0, 0)]


@pytest.mark.parametrize(("weights", "hits"), [([5, 3, 1], [6, 3, 0]), ([0, 100, 100], [1, 100, 99]), ([1, 1, 1], [2, 1, 0])])
def test_pick_keeps_the_loop_of_running_sums(spark, weights, hits):
    df = spark.createDataFrame(list(enumerate(weights)), "Id int, w int")
    total, got = sum(weights), [0] * len(weights)
    draws = range(total) if total < 20 else (0, 1, 99, 100, 101, 199)
    for r in draws:
        got[picking.weighted_pick(df, "Id", "w", (r + 0.5) / total).first().Id] += 1
    if total < 20:
        assert got == hits
    else:
        assert got[0] == 1


def test_pick_of_nothing_and_running_totals(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "Id int, w int")
    assert picking.weighted_pick(df.where("false"), "Id", "w", 0.5).count() == 0
    assert picking.weighted_pick(df.where("w = 0"), "Id", "w", 0.5).first().Id == 0
    assert rows(picking.running_total(df, "Id", "w", 8)) == rows(picking.running_total(df, "Id", "w", 1000))
    assert picking.weighted_pick_unbiased(df.where("w = 0"), "Id", "w", 1).count() == 0
    drawn = [picking.weighted_pick_unbiased(df.where("Id in (1, 4)"), "Id", "w", s).first().Id for s in range(40)]
    assert drawn.count(4) > drawn.count(1) > 0


def test_searches(spark):
    df = spark.createDataFrame([(1, "Ação 100%"), (2, "ruído  noturno"), (3, None)], "Id int, t string")
    assert [r.Id for r in filters.search(df, "AÇÃO", "t").collect()] == [1]
    assert [r.Id for r in filters.search(df, "%", "t").collect()] == [1]
    assert [r.Id for r in filters.search(df, "  ", "t").collect()] == [2]
    assert filters.search(df, "", "t").count() == filters.search(df, None, "t").count() == 3
    assert [r.Id for r in filters.search(df, "3", "t", "Id").collect()] == [3]


def test_criteria(spark):
    df = spark.createDataFrame([(1, "X", "2020-01-01", 0), (2, "Y", "2021-01-01", 100), (3, None, None, 100)], "Id int, Legislatura string, VoteDate string, Score int")
    ids = lambda **k: [r.Id for r in filters.by_criteria(df, **k).orderBy("Id").collect()]
    assert ids() == [1, 2, 3]
    assert ids(legislatures=[]) == []
    assert ids(legislatures=["Y"]) == [2]
    assert ids(oldest="2020-01-01", newest="2020-12-31") == [1]
    assert ids(lowest_score=1) == [2, 3]


def test_nesting(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "Id int, n string")
    children = spark.createDataFrame([(10, 1), (9, 1), (8, None), (7, 5)], "c int, p int")
    got = {r.n: [x.c for x in r.kids] for r in nesting.with_children(parents, "Id", children, "p", "kids").collect()}
    assert got == {"a": [9, 10], "b": [], "c": []}
    looked = nesting.with_parent(children, "p", parents, "Id", "parent")
    assert {r.c: r.parent and r.parent.n for r in looked.collect()} == {10: "a", 9: "a", 8: None, 7: None}
    assert rows(nesting.without(children.select("c", "p"), "p", parents, "Id").select("c")) == [(7,), (8,)]
    assert nesting.for_each(parents.where("Id = 1"), records.seed_parties(spark), "partyAcronym").count() == 4
    assert nesting.for_each(parents, parents.where("false"), "n").count() == 0


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", None), (None, "c", 7)], "Id int, t string, v int")
    patch = spark.createDataFrame([(1, None, 9), (3, "z", 1)], "Id int, t string, v int")
    assert {tuple(r) for r in mutations.patched(base, patch, "Id").collect()} == {(1, "a", 9), (2, "b", None), (None, "c", 7)}
    assert {r.Id for r in mutations.deleted(base, "Id", 1).collect()} == {2, None}
    assert {(r.t, r.Id) for r in mutations.detached(base, "Id", 1).collect()} == {("a", None), ("b", 2), ("c", None)}
    assert mutations.emptied(base).count() == 0
    new = spark.createDataFrame([("a", 1), ("x", 5), ("y", 6), (None, 8)], "t string, v int")
    assert {r.t for r in mutations.accepted(new, base, "t", "v").collect()} == {"y", None}
    assert {(r.t, r.conflict) for r in mutations.rejected(new, base, "t", "v").collect()} == {("a", "t"), ("x", "v")}
    assert rows(mutations.with_new_ids(new.where("v > 5").withColumn("Id", F.lit(0)), base, "Id", "v").select("Id", "v")) == [(3, 6), (4, 8)]
    assert {(r.Id, r.t) for r in mutations.get_or_create(base, spark.createDataFrame([("a",), ("q",)], "t string"), "t").collect()} == {(1, "a"), (None, "q")}


def test_texts(spark):
    df = spark.createDataFrame([("<p>A <censored> b</p>\nc &amp; d",), ("",), (None,)], "t string")
    assert [r.c for r in df.select(text.stripped_html(F.col("t")).alias("c")).collect()] == ["A CENSURADO bc  d", "", None]
    mails = spark.createDataFrame([("a.b@x.org",), (" a@b.c",), ("a@b",), ("",), (None,), ("a@b.c !!",)], "t string")
    assert [r.v for r in mails.select(text.looks_like_email(F.col("t")).alias("v")).collect()] == [True, False, False, False, False, True]
    names = spark.createDataFrame([("\xa0Água ",), ("Á.G.U.A",), ("ni-02",), ("",), (None,)], "t string")
    assert [r.n for r in names.select(keys.letters_and_digits(F.col("t")).alias("n")).collect()] == ["AGUA", "AGUA", "NI02", "", None]


def test_records(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert records.as_json(df).first().json == '{"a":1,"b":null}'
    back = records.parsed(spark.createDataFrame([('{"a": 3}',), ("broken{",), (None,)], "p string"), "p", df.schema)
    assert [r.a for r in back.collect()] == [3, None, None]
    assert len(records.enveloped(records.seed_parties(spark), "parties", F.col("partyAcronym")).first().parties) == 4


def test_queries_match_their_sql(spark, data_dir, tmp_path):
    con = duckdb.connect()
    for t in ("parties", "proposals", "voting_results", "voting_blocks", "users", "votes", "party_stats", "record_log", "proposal_records"):
        con.execute(f"create view {t} as select * from read_parquet('{data_dir}/{t}.parquet')")
    from hemicycle.plans import catalogue, integrity, oracle

    sql = {**oracle.SQL, **catalogue.SQL}
    for name, f in {**integrity.queries(), **catalogue.QUERIES}.items():
        if name not in sql:
            continue
        df = f(spark, data_dir)
        columns = ", ".join(f'"{c}"' for c in df.columns)
        expected = con.execute(f"select {columns} from ({sql[name]}) t").fetchall()
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(expected, key=key), name


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
