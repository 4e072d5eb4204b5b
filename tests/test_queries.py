"""Queries against their SQL in DuckDB, on the smallest tables."""

import importlib.util
import os
import re

import pytest

import __spark_entry__ as entry

SF = os.environ.get("FACTWEAVE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in order) for r in got.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 110


def test_rest_does_not_import_llm():
    found = importlib.util.find_spec("factweave").submodule_search_locations[0]
    for folder, _, files in os.walk(found):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as file:
                        assert not re.search(r"\bllm\b", file.read()), f
