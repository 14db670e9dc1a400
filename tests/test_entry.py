import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


CORE = sorted(n for n in entry.queries() if not (n.startswith("p") and n[1].isdigit()) or n.split("_")[0] in ("p1", "p4", "p7"))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql:
        out = duck.sql(sql)
        assert sorted(out.columns) == sorted(df.columns)
        at = [out.columns.index(c) for c in sorted(out.columns)]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_everything_else_works_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['sieveline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(n.startswith(('p2_', 'p10_')) for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_outside_imports_the_llm_subpackage():
    for f in (ROOT / "sieveline").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
