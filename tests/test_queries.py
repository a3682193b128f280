"""Every registered query against its SQL, on the same tables."""

import math
import os

import duckdb
import pytest

from tests.conftest import SMALL
from tracewell.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert found
    if name in SQL:
        made = duck.execute(SQL[name])
        names = [c[0] for c in made.description]
        assert sorted(names) == sorted(df.columns)
        assert found == rows_of(names, made.fetchall())
