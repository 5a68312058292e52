"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import os

import pytest

from driftwood.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(frame):
    cell = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr([cell(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in queries.ORACLE_SQL:
        assert plain(found) == plain(duck.sql(queries.ORACLE_SQL[name]).df())


def test_subjects_hold_whole_turns(spark):
    from driftwood.plans import corpora

    whole = {(r.conv_id, r.turn): r.text.replace("\n", " ") for r in corpora.read(spark, SF, "conversations").collect() if r.text is not None}
    assert any(len(t) > 60 for t in whole.values())
    for r in corpora.subjects(spark, SF).collect():
        assert r.subject is None or r.subject.endswith(whole[r.conv_id, r.turn])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
