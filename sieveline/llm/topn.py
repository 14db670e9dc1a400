"""Top N items within every group: score histograms give a safe threshold, exact ranking follows.

Rows are laid out once, by group and, for large groups only, by a salt of the item. Everything up to the last ranking
happens in that layout; what moves after it is at most N rows of each group and salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fits, small

#: Groups with more rows than this are large: they are salted, and get a histogram.
LARGE = 4_096
#: Rows a salt of a large group should hold.
SALT_ROWS = 65_536
BINS = 256


def top_n(df: DataFrame, group: Sequence[str], item: str, score: str, version: str, n: int, large: int = LARGE, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``group``, rnk (1 to n), ``version``, ``item``, ``score``: the n highest scores of every group.

    Of several rows of an item in a group only the one with the largest ``version`` counts; if its score is null
    (or not a number), the item drops out. Ties go to the smaller item. Rows with a null in ``group`` do not count; a
    null item is an item of its own, ranked first among equals. Repeated rows count once. Columns besides the named
    ones are left out, so their names cannot clash. An empty table gives an empty result.
    """
    group = list(group)
    rows = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.col(item).alias("item"), F.col(score).cast("double").alias("score"), F.col(version).alias("version"))
    g = [f"g{i}" for i in range(len(group))]
    rows = rows.dropna(subset=g)
    sizes = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > large)
    hot = sizes.withColumn("salts", F.ceil(F.col("rows") / salt_rows).cast("int")).drop("rows")
    hot = cut(hot)
    few = fits(hot)  # what is kept for a large group below has no more rows than this
    hot = small(hot, few)
    # An item may have most rows of a large group: these are reduced to one an item before anything is laid out.
    latest = F.max(F.struct("version", "score")).alias("last")
    cold = rows.join(hot, g, "left_anti").withColumn("salts", F.lit(0))
    salted = cold.unionByName(rows.join(hot, g).groupBy(*g, "item", "salts").agg(latest).select(*g, "item", "last.score", "last.version", "salts"))
    salted = salted.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("item"), F.col("salts").cast("long"))).otherwise(F.lit(0).cast("long")))
    laid = salted.select(*g, "salt", (F.col("salts") > 0).alias("large"), "item", "score", "version").repartition(*g, "salt")
    latest = laid.groupBy(*g, "salt", "item").agg(latest, F.first("large").alias("large"))
    latest = latest.select(*g, "salt", "item", "large", "last.version", "last.score").where("score is not null and not isnan(score)")
    least = thresholds(latest.where("large"), g, n, few)
    kept = latest.join(small(least, few), g, "left").where("least_score is null or score >= least_score")
    order = [F.col("score").desc(), F.col("item").asc_nulls_first()]
    part = kept.withColumn("rnk", F.row_number().over(Window.partitionBy(*g, "salt").orderBy(*order))).where(F.col("rnk") <= n)
    best = part.withColumn("rnk", F.row_number().over(Window.partitionBy(*g).orderBy(*order))).where(F.col("rnk") <= n)
    return best.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(group)], "rnk", F.col("version").alias(version), F.col("item").alias(item), F.col("score").alias(score))


def thresholds(rows: DataFrame, g: Sequence[str], n: int, few: bool) -> DataFrame:
    """``g``, least_score: of each group, a score that at least n of its rows reach; groups with fewer rows have none.

    ``few`` tells whether one row a group fits a broadcast.
    Bins are equal parts of each group's own range of scores. Every bin's least score is kept, so the threshold is a
    score that occurs and no rounding of bin edges can lose a row.
    """
    g = list(g)
    spans = rows.groupBy(*g).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / BINS
    at: Column = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(BINS - 1))).otherwise(F.lit(0))
    bins = rows.join(small(spans, few), g).groupBy(*g, at.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least"))
    above = Window.partitionBy(*g).orderBy(F.col("bin").desc())
    reached = bins.withColumn("total", F.sum("c").over(above)).where(F.col("total") >= n)
    return reached.groupBy(*g).agg(F.max("least").alias("least_score"))


def found(scores: DataFrame) -> DataFrame:
    """role_id, run_id, rnk, id: the three best candidates of every run of a role; null and tied values as in top_n."""
    best = top_n(scores, ["role_id", "run_id"], "candidate_id", "final_score", "id", 3)
    return best.select("role_id", "run_id", "rnk", "id")
