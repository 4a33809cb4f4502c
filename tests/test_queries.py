"""Every query of the library against its SQL, both over the whole small tables."""

import os

import pytest

from emberline.plans import oracles, queries
from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")
SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in oracles.SQL:
        assert rows or name == "j2_stream_sessions"
        return
    rel = duck.sql(oracles.SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert cols == sorted(rel.columns)
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds


def test_every_oracle_has_a_query():
    assert set(oracles.SQL) <= set(queries.QUERIES)
