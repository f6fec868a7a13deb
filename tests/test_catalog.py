"""Every registered query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from pathflow import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        out.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return out


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equal_to_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert plain(map(tuple, df.collect())) == plain(con.execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_every_query_is_registered(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
