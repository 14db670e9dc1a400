import random

import pytest
from helpers import F

from sieveline.operators.ranks import placed


@pytest.mark.parametrize("partitions", [1, 9])
def test_places_against_a_sort(spark, partitions):
    r = random.Random(partitions)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, 3.5]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, s double, id long")
    got = {x["id"]: x["rank"] for x in placed(df, "g", [F.col("s").desc_nulls_last(), F.col("id").asc()], partitions=partitions).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        for n, (_, s, i) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))):
            want[i] = n + 1
    assert got == want
    assert placed(df.limit(0), "g", [F.col("s").asc()]).collect() == []
