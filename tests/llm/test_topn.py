import random

import pytest
from helpers import rows

from sieveline.llm import topn

SCHEMA = "role string, run string, cand string, score double, id long, salt string, item string, rnk string, version string"


def table(spark, items):
    return spark.createDataFrame([(*i, "clash", "clash", "clash", "clash") for i in items], SCHEMA)


def brute(items, n):
    last = {}
    for g, r, c, s, i in items:
        if g is not None and r is not None and (g, r, c) not in last or g is not None and r is not None and last[g, r, c][0] < i:
            last[g, r, c] = (i, s)
    by = {}
    for (g, r, c), (i, s) in last.items():
        if s is not None and s == s:
            by.setdefault((g, r), []).append((-s, c is not None, c or "", i))
    return sorted(((g, r, k + 1, i) for (g, r), l in by.items() for k, (_, _, _, i) in enumerate(sorted(l)[:n])), key=repr)


@pytest.mark.parametrize("large, salt_rows", [(4096, 65536), (50, 20), (1, 1)])
def test_against_brute_force(spark, large, salt_rows):
    r = random.Random(large)
    items = []
    for i in range(4000):
        hot = r.random() < 0.4
        g, run = ("hot", "1") if hot else (r.choice(["a", "b", None, "c"]), r.choice(["1", "2", None, *map(str, range(3, 90))]))
        s = r.choice([None, float("nan"), 1.0, 2.5, 2.5, 99.0]) if r.random() < 0.5 else r.random() * 100
        items.append((g, run, r.choice([None, *(f"c{k}" for k in range(300))]), s, i))
    items += [("same", "1", f"c{k:03}", 7.0, 5000 + k) for k in range(300)] + items[:40]
    got = topn.top_n(table(spark, items), ["role", "run"], "cand", "score", "id", 3, large, salt_rows)
    assert rows(got.select("role", "run", "rnk", "id")) == brute(items, 3)


def test_thresholds_are_safe(spark):
    items = [("g", float(s)) for s in (1, 2, 2, 3, 1e18, -1e18)] + [("few", 1.0)] + [("flat", 5.0)] * 9
    got = {r["g0"]: r["least_score"] for r in topn.thresholds(spark.createDataFrame(items, "g0 string, score double"), ["g0"], 3, True).collect()}
    assert got["flat"] == 5.0 and "few" not in got and sum(s >= got["g"] for g, s in items if g == "g") >= 3


def test_an_item_with_most_rows_of_a_group(spark):
    items = [("hot", "1", "same", float(i % 97), i) for i in range(6000)] + [("hot", "1", f"c{k}", 50.0 + k, 7000 + k) for k in range(5)]
    got = topn.top_n(table(spark, items), ["role", "run"], "cand", "score", "id", 3, 100, 50)
    assert rows(got.select("role", "run", "rnk", "id")) == brute(items, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_no_rows(spark):
    assert topn.top_n(table(spark, []), ["role", "run"], "cand", "score", "id", 3).collect() == []
