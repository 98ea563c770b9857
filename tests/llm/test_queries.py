import duckdb

from hemicycle.llm import queries


def test_queries_match_their_sql(spark, data_dir):
    con = duckdb.connect()
    for t in ("voting_blocks", "proposals", "documents", "mix_targets"):
        con.execute(f"create view {t} as select * from read_parquet('{data_dir}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, data_dir)
        expected = con.execute(f"select {', '.join(df.columns)} from ({sql}) t").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(expected), name


def test_found_queries_have_their_columns(spark, data_dir):
    expected = {
        "p2_found": [("proposal_id", "int"), ("article_no", "int")],
        "p4_found": [("item_a", "string"), ("item_b", "string")],
        "p7_found": [("mix_id", "string"), ("source", "string")],
        "p8_found": [("doc_id", "bigint"), ("kind", "string")],
    }
    for name, columns in expected.items():
        assert queries.queries()[name](spark, data_dir).dtypes == columns
