"""Every query that has SQL, against DuckDB on the small tables."""

import os

import duckdb
import pytest

from graphloom.plans import core, parts, source_trees, text_and_shape

SF = "/root/testdata/sf0.001"
ALL = core.QUERIES | text_and_shape.EXTRA


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(columns, values):
    return sorted(str([v.item() if hasattr(v, "item") else v for v in row]) for row in values) if columns else []


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, tables, name):
    got = ALL[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.sql(core.ORACLES[name])
    assert sorted(want.columns) == columns
    wanted = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows(columns, [tuple(r) for r in got.select(*columns).collect()]) == rows(columns, wanted)


def test_entry_runs_without_the_training_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
