"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from weft.plans.queries import QUERIES, SQL
from weft.sources import edges as sources


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, found.select(*columns).collect())) == plain(want.project(listed).fetchall())


def test_generated_wide_at_its_published_size(spark, duck, tmp_path):
    """1.8 million rows, by the SQL of the registered query over that range of numbers."""
    path = str(tmp_path / "rows")
    sources.generate_wide(spark).write.parquet(path)
    sql = SQL["generated_wide"].replace("(SELECT 200000 + row_number() OVER () AS id FROM lineitem)", "range(200001, 2000001) r(id)")
    duck.sql(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    listed = ", ".join(c for c, *_ in duck.sql("DESCRIBE want").fetchall())
    both = [f"(SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b})" for a, b in (("want", f"'{path}/*.parquet'"), (f"'{path}/*.parquet'", "want"))]
    assert duck.sql("SELECT count(*) FROM want").fetchall()[0][0] == 1_800_000 and not duck.sql(" UNION ALL ".join(both)).fetchall()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
