import duckdb
import pytest

from weftmark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(pdf):
    names = sorted(pdf.columns)
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return names, sorted(repr([plain(x) for x in row]) for row in pdf[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = canonical(registry.QUERIES[name](spark, DATA).toPandas())
    assert got == canonical(duck.execute(registry.ORACLES[name]).df())
    assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
