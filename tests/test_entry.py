import os

import duckdb
import pytest

import __spark_entry__ as entry
from schemaloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.oracle_sql()])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted((list(r) for r in con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want
