"""Every registered query against its DuckDB SQL on the small tables."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessella.plans import signal_queries as _registered  # noqa: F401
from tessella.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, FOLDER).toPandas()
    expected = duck.execute(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
    assert len(found)


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parent.parent
    for path in (root / "tessella").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tessella.llm" not in path.read_text(), path
