import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.llm import quality, tokens


def stats(spark, *texts):
    df = spark.createDataFrame([(i, t, 9.0, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words double, kind string")
    return [r.asDict() for r in quality.statistics(df, "text").orderBy("doc_id").collect()]


def test_statistics(spark):
    one, table, items, empty, null = stats(spark, "O gato não dorme.\nA casa é branca", "a\tb\tc\n1\t2\t3", "<ul><li>um</li><li>dois</li></ul>", "", None)
    assert one["n_words"] == 8 and one["mean_word_length"] == pytest.approx(25 / 8)
    assert one["punctuated_share"] == 0.5 and one["common_share"] == 0.5 and one["clause_share"] == 0.25
    assert one["symbol_ratio"] == pytest.approx(1 / 26)
    assert table["cell_share"] == 1 and items["marker_share"] == 1
    for s in (empty, null):
        assert s["n_chars"] == 0 and all(s[k] == 0 for k in quality.STATISTICS)
    assert one["kind"] == "k"
    assert one["vowel_ratio"] == pytest.approx(13 / 25)
    odd, digits, commas, capitals = stats(spark, "Ã£o Ã³timo", "٣٤ ab", "a, b, c", "ŁÓDŹ Δ")
    assert odd["odd_ratio"] > 0.1 and digits["digit_ratio"] == 0.5 and commas["commas_per_word"] == pytest.approx(2 / 3) and capitals["capital_ratio"] == 1
    assert stats(spark, "xkcdw aeiou normal")[0]["clusters_per_word"] == pytest.approx(2 / 3)


def test_repetition_and_long_text(spark):
    again, long = stats(spark, "A mesma coisa. " * 30, "palavra " * 200_000)
    assert again["repeated_share"] > 0.9
    assert long["n_words"] == 200_000 and long["distinct_share"] == pytest.approx(1 / 200_000)


def test_rules_find_intervals_and_sql_agrees(spark):
    rng = np.random.default_rng(0)
    x = {s: rng.random(1500) for s in quality.STATISTICS}
    a, b = x["cell_share"], x["digit_ratio"]
    kinds = np.where((a > 0.7) & (b > 0.3), "table", np.where(a < 0.15, "it's", "prose"))
    noisy = np.where(rng.random(1500) < 0.03, "table", kinds)
    rules = quality.induce(x, noisy)
    assert rules[-1].conditions == () and rules[-1].kind == "prose"
    assert np.mean(quality.predict(rules, x) == kinds) > 0.95
    rows = spark.createDataFrame([tuple(float(x[s][i]) for s in quality.STATISTICS) for i in range(300)], list(quality.STATISTICS))
    got = [r.k for r in rows.select(F.expr(quality.case_sql(rules)).alias("k")).collect()]
    assert got == quality.predict(rules, {s: v[:300] for s, v in x.items()}).tolist()


def test_no_labels_and_one_kind(spark):
    x = {s: np.zeros(3) for s in quality.STATISTICS}
    assert quality.case_sql(quality.induce({s: np.zeros(0) for s in quality.STATISTICS}, np.array([], str))) == "'prose'"
    assert quality.induce(x, np.array(["list"] * 3)) == [quality.Rule("list", ())]
    docs = spark.createDataFrame([(1, "Bom dia."), (2, None)], "doc_id long, text string")
    rules = quality.fit(docs, spark.createDataFrame([(1, None), (None, "list"), (7, "junk"), (2, "a"), (2, "b")], "doc_id long, kind string"), "doc_id", "text")
    assert {r.kind for r in quality.kinds(docs, rules, "text").collect()} == {"prose"}


def test_every_threshold_is_tried():
    values = np.arange(5000, dtype=float)
    rule = quality._grown({"n_words": values}, (values >= 1717) & (values < 1719), "list")
    assert rule.covers({"n_words": values}).nonzero()[0].tolist() == [1717, 1718]


def test_sample_of_labels_and_given_rules(spark):
    docs = spark.createDataFrame([(i, "Uma frase que diz alguma coisa." if i % 2 else "- um\n- dois\n- três") for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 2 = 1, 'prose', 'list') as kind")
    rules = quality.fit(docs, labels, "doc_id", "text", fit_rows=60)
    judged = quality.kinds(docs, rules, "text")
    assert judged.join(labels.withColumnRenamed("kind", "truth"), "doc_id").where("kind <> truth").count() == 0
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert quality.kinds(read, rules, "text")._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/doc_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rules = quality.fit(docs, labels.where(~held), "doc_id", "text")
    judged = quality.kinds(docs.join(F.broadcast(labels.where(held).select("doc_id", F.col("kind").alias("truth"))), "doc_id"), rules, "text")
    right, n = judged.agg(F.count_if(F.col("kind") == F.col("truth")), F.count("*")).first()
    assert n > 100 and right / n > 0.95


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Uma frase, e 12 números.", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "text").collect()}
    assert got[2] == got[3] == 0 and 5 <= got[1] <= 12 and got[4] > 1
    assert tokens.token_counts(df.where("false"), "text").columns == ["doc_id", "n_tokens"]
