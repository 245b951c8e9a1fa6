"""Each query of the domain against its SQL on the smallest tables."""

import duckdb
import pytest

from tessera.plans import changes, chunks, controls, domain, exports, fusion, inventory, more, official, repairs, reports, statements, structure, words  # noqa: F401
from tessera.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    f = float(v)
    return round(f, 9) + 0.0


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, folder, sql, name):
    got = QUERIES[name](spark, folder)
    want = sql.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
