"""Every query that has an oracle against DuckDB on the smallest tables; the driver compares all of them at sf0.01."""

import concurrent.futures
import glob
import os

import duckdb
import pytest

from stratamem import registry

SF = "/root/testdata/sf0.001"
NAMES = [n for m in registry.MODULES for n in m.ORACLES]


def oracle(sql):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c.sql(sql)


@pytest.fixture(scope="module")
def answers(spark):
    """Columns and rows of each query; several run side by side, since most of a small query is waiting."""

    def run(name):
        df = registry.queries()[name](spark, SF)
        columns = sorted(df.columns)
        return columns, sorted(str(tuple(r[c] for c in columns)) for r in df.collect())

    with concurrent.futures.ThreadPoolExecutor(6) as pool:
        running = {n: pool.submit(run, n) for n in NAMES}
    return running


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(answers, name):
    columns, got = answers[name].result()
    want = oracle(registry.oracles()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
