"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os
from pathlib import Path

import pytest

from skein.plans import catalog

FOLDER = Path(os.environ.get("SKEIN_TABLES", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v

    return sorted(([one(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = catalog.queries()[name](spark, str(FOLDER))
    rel = db.sql(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    want = rel.project(", ".join(names)).fetchall()
    assert plain(got.select(*names).collect()) == plain(want)


def test_sql_has_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def against_sql(spark, folder, name):
    """Rows of the query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, rel = catalog.queries()[name](spark, str(folder)), con.sql(catalog.oracle_sql()[name])
    return plain(got.select(*sorted(got.columns)).collect()), plain(rel.project(", ".join(sorted(got.columns))).fetchall())


def test_frames_of_more_than_six_digits(spark, tmp_path):
    duckdb.connect().sql(f"COPY (SELECT * FROM (VALUES (7::BIGINT, 1::INT), (999999, 3), (1000000, 3), (1234567, 4)) t(p_partkey, p_size)) TO '{tmp_path}/part.parquet'")
    got, want = against_sql(spark, tmp_path, "names_and_keys")
    assert got == want and len(got) == 4
