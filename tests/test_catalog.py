"""Every catalogue query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from opsloom.plans import oracle_sql, queries

SF = "/root/testdata/sf0.001"
#: Queries that SQL can't express; the tests of their operators hold them against plain Python.
WITHOUT_SQL = {"mined_templates", "learning_states", "learned_shifts", "blended_lessons", "storm_causes"}


def shape(v):
    return float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(queries()) - WITHOUT_SQL))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})")
    key = lambda rows: sorted(repr(tuple(shape(v) for v in r)) for r in rows)
    assert key(df.select(*cols).collect()) == key(cur.fetchall())


def test_all_others_have_sql():
    assert set(queries()) - set(oracle_sql()) == WITHOUT_SQL
