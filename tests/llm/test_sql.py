"""Queries of the training-data operators against their SQL."""

import duckdb
import pytest

from tests.conftest import MEDIUM, SMALL
from tracewell.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    folder = MEDIUM if name.startswith("op6") else SMALL
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    made = con.execute(oracle_sql()[name])
    names = [c[0] for c in made.description]
    df = queries()[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(made.fetchall(), key=repr)
