"""Every query against its SQL on the smallest tables; for those without, see test_without_sql."""

import duckdb
import pytest

from flowquarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def canonical(rows):
    def one(x):
        if x is None or x != x:
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(name, spark, sf_dir, con):
    df = catalogue.queries()[name](spark, sf_dir)
    sql = catalogue.oracle_sql()[name]
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert canonical(rows) == canonical([[r[i] for i in order] for r in found.fetchall()])
