"""The catalogue against DuckDB on the small tables, where they are there."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tabulens import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda rows, have: sorted((tuple(plain(r[have.index(c)]) for c in sorted(have)) for r in rows), key=str)
    assert sorted(got.columns) == sorted(names)
    assert key(got.collect(), got.columns) == key(want.fetchall(), names)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_part():
    import subprocess

    code = "import sys; sys.modules['tabulens.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
