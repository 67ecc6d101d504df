"""Run a query on Spark and its SQL on DuckDB and compare rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def assert_same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = _rows(query(spark, sf_dir).toPandas()), _rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
