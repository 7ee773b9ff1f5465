"""Every query with SQL gives the rows that DuckDB gives for it."""
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return int(x) if hasattr(x, "as_integer_ratio") and not isinstance(x, (bool, float)) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    mine = rows(df.columns, df.collect())
    ran = db.execute(entry.oracle_sql()[name])
    theirs = rows([d[0] for d in ran.description], ran.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in ran.description)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
