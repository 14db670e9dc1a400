from pathlib import Path

import duckdb
import pytest

from sieveline.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name.endswith("_found") and name != "p10_found":  # too few ratings at this size to learn from
        assert got and len(got) == len(set(got))
    if name in Q.ORACLE:
        con = duckdb.connect()
        for f in Path(data).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        out = con.sql(Q.ORACLE[name])
        at = [out.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=repr)
