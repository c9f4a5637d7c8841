"""Every catalogue query against its SQL in DuckDB, on the smallest tables; those without SQL must give rows."""

import math
from collections import Counter

import duckdb
import pytest

from spectrail.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert rows
    if name in catalogue.ORACLES:
        result = duck.execute(catalogue.ORACLES[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == Counter(tuple(plain(x[i]) for i in at) for x in result.fetchall())
        kinds = dict(df.dtypes)
        assert {c: KINDS[kinds[c]] for c in cols} == {x[0]: str(x[1]) for x in result.description}
