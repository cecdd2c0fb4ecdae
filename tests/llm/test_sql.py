"""The registered SQL against the queries, on the small tables."""

import duckdb
import pytest

from orebody.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    plain = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(found.fetchall())


def test_every_operator_has_a_query():
    assert [sum(k.startswith(f"op{n}_") for k in queries.QUERIES) for n in range(1, 11)] == [1] * 10
