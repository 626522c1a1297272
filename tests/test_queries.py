"""Every query of the engine against its SQL over the tables that its documents were rendered from."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

from treeframe.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: f"{x:.12g}" if isinstance(x, float) and not math.isnan(x) else x if x is None else str(x)
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_all_have_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    out = QUERIES[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert canonical(out.columns, [tuple(r) for r in out.collect()]) == canonical(columns, want.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys() and SQL.items() <= e.oracle_sql().items()
    assert e.oracle_sql().keys() <= e.queries().keys()


@pytest.mark.parametrize("gone", ["corpus_pipeline", "treeframe.llm.queries"])
def test_entry_without_the_llm_folders(monkeypatch, gone):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, gone, None)
    assert e.queries().keys() == QUERIES.keys() and e.oracle_sql().keys() == SQL.keys()


def test_entry_hides_no_other_missing_module(monkeypatch):
    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith(("treeframe.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    if (Path(e.__file__).parent / "treeframe/llm/queries.py").exists():
        with pytest.raises(ModuleNotFoundError, match="xxhash"):
            e.queries()
