import datetime as dt
import random

import pytest
from helpers import job, resume, resumes, rows

from sieveline.operators import experience, intervals


def brute(items):
    out = []
    by = {}
    for k, a, b in items:
        if k is not None and a is not None and b is not None and a <= b:
            by.setdefault(k, []).append((a, b))
    for k, l in by.items():
        l.sort()
        cur, n = list(l[0]), 1
        for a, b in l[1:]:
            if a <= cur[1]:
                cur[1], n = max(cur[1], b), n + 1
            else:
                out.append((k, *cur, n))
                cur, n = [a, b], 1
        out.append((k, *cur, n))
    return sorted(out)


@pytest.mark.parametrize("partitions, seed", [(1, 1), (7, 2), (40, 3)])
def test_against_brute_force(spark, partitions, seed):
    r = random.Random(seed)
    items = []
    for _ in range(3000):
        k = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", "dd", "e", None])
        a = r.randint(-500, 3000) if r.random() < 0.97 else None
        items.append((k, a, None if a is None or r.random() < 0.02 else a + r.randint(-2, 12)))
    items += items[:50] + [("hot", -1000, 5000), ("lone", 5, 5)]
    df = spark.createDataFrame(items, "k string, lo long, hi long").withColumnRenamed("k", "entity2")
    got = intervals.merge_intervals(df, "entity2", "lo", "hi", partitions)
    assert sorted((x["entity"], x["lo"], x["hi"], x["n"]) for x in got.collect()) == brute(items)
    labels = [x["label"] for x in got.orderBy("entity", "lo").collect()]
    assert labels == list(range(1, len(labels) + 1))
    holes = {(x["entity"], x["lo"], x["hi"]) for x in intervals.gaps(got).collect()}
    want = brute(items)
    assert holes == {(x[0], x[2], y[1]) for x, y in zip(want, want[1:]) if x[0] == y[0]}


def test_wide_numbers(spark):
    df = spark.createDataFrame([("a", 10**15, 10**15 + 5), ("b", -(10**15), 0), ("a", 10**15 + 5, 10**15 + 9)], "k string, lo long, hi long")
    assert sorted(r["hi"] for r in intervals.merge_intervals(df, "k", "lo", "hi").collect()) == [0, 10**15 + 9]


def test_rules_of_jobs(spark):
    df = resumes(
        spark,
        resume("touch", total=2.0, experience=[job("2020-01-01", "2021-01-01"), job("2021-01-01", "2022-01-01")]),
        resume("open", total=9.0, experience=[job("2020-01-01", "2021-01-01"), job("2024-01-01", None)]),
        resume("two open", experience=[job("2024-01-01", None), job("2024-01-01", "n/a"), job("2020", "2021")]),
        resume("future", experience=[job("2030-01-01", "2031-01-01"), job("2024-07-01", "2031-01-01")]),
        resume("reversed", total=1.0, experience=[job("2021", "2020")]),
        resume("no start", experience=[job(None, "2020"), job("x", "Present")]),
        resume("until now", experience=[job("2025-06-01", "Present")]),
        resume("null"),
        resume("nothing", experience=[]),
    )
    got = rows(intervals.found(df.union(df), dt.date(2025, 7, 1)))
    assert got == sorted(
        [
            ("touch", "period", "2020-01-01", "2022-01-01"), ("open", "period", "2020-01-01", "2021-01-01"), ("open", "period", "2024-01-01", "2025-07-01"), ("open", "gap", "2021-01-01", "2024-01-01"),
            ("open", "total", "2020-01-01", "2025-07-01"), ("two open", "period", "2020-01-01", "2021-01-01"), ("future", "period", "2024-07-01", "2025-07-01"), ("until now", "period", "2025-06-01", "2025-07-01"),
        ], key=repr,
    )
    assert intervals.found(df.limit(0)).collect() == []


def test_total_years(spark):
    df = resumes(spark, resume("a", total=5.0, experience=[job("2020-01-01", "2022-01-01"), job("2021-01-01", "2021-06-01"), job("x", "2020")]), resume("none"))
    got = {r["candidate_id"]: r for r in experience.total_years(df, dt.date(2025, 7, 1)).collect()}
    assert (got["a"]["total_years"], got["a"]["n_used"], got["none"]["total_years"]) == (2.0, 2, 0.0)
    assert got["a"]["warnings"] == ["1 jobs without a readable start"]
    stated = {r["candidate_id"]: r["total_years"] for r in experience.total_years(df, dt.date(2025, 7, 1), "total_years_experience").collect()}
    assert stated["a"] == 5.0
