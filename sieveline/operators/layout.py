"""Two-column pages: the cut of the left edges that parts them best, and the reading order it gives.

The cut is looked for among the sorted distinct left edges of a page's narrow blocks: running sums give the means of
both sides of every cut at once, and the cut with the greatest spread between the sides is kept. All of it is windows
over a page, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of a full-width block, least blocks, gap of columns and common height, as parts of the page; least blocks of a column.
FULL, BLOCKS, GAP, COMMON, COLUMN = 0.6, 4, 0.03, 0.3, 2

PAGE = ("doc_id", "page")


def column_cuts(narrow: DataFrame) -> DataFrame:
    """doc_id, page, at: where the narrow blocks of a page part into two columns; pages of one column give no row."""
    edges = narrow.groupBy(*PAGE, "x0").agg(
        F.count(F.lit(1)).alias("n"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max("page_width").alias("width"), F.max("page_height").alias("height")
    )
    whole = Window.partitionBy(*PAGE)
    so_far = whole.orderBy("x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = whole.orderBy("x0").rowsBetween(1, Window.unboundedFollowing)
    weight = F.col("n") * F.col("x0")
    sides = edges.select(
        *PAGE, "x0", "width", "height", F.sum("n").over(so_far).alias("n_left"), F.sum("n").over(to_come).alias("n_right"), F.sum(weight).over(so_far).alias("s_left"), F.sum(weight).over(to_come).alias("s_right"),
        F.min("top").over(so_far).alias("top_left"), F.min("top").over(to_come).alias("top_right"), F.max("bottom").over(so_far).alias("bottom_left"), F.max("bottom").over(to_come).alias("bottom_right"),
    ).where("n_right is not null")
    sides = sides.withColumns({"left": F.col("s_left") / F.col("n_left"), "right": F.col("s_right") / F.col("n_right")})
    spread = F.col("n_left") * F.col("n_right") * (F.col("right") - F.col("left")) ** 2
    kept = ("left", "right", "n_left", "n_right", "width", "height", "top_left", "top_right", "bottom_left", "bottom_right")
    best = sides.groupBy(*PAGE).agg(F.max(F.struct(spread.alias("spread"), (-F.col("x0")).alias("minus"), *kept)).alias("b")).select(*PAGE, "b.*")
    shared = F.least("bottom_left", "bottom_right") - F.greatest("top_left", "top_right")
    fine: Column = (F.col("n_left") + F.col("n_right") >= BLOCKS) & (F.least("n_left", "n_right") >= COLUMN)
    fine = fine & (F.col("right") - F.col("left") >= GAP * F.col("width")) & (shared >= COMMON * F.col("height"))
    return best.where(fine).select(*PAGE, ((F.col("left") + F.col("right")) / 2).alias("at"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """doc_id, page, two_columns, text of blocks (doc_id, page, page_width, page_height, x0, y0, x1, y1, text).

    Wide blocks above the columns come first, then the left column, the right one, and the other wide blocks; pages of
    one column keep the order of y0 and x0. Blank blocks are left out. What is gathered is a page, never a document.
    """
    slim = blocks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "page_width", "page_height", "x0", "y0", "x1", "y1", "text")
    slim = slim.where("length(trim(text)) > 0").withColumn("narrow", (F.col("x1") - F.col("x0")) <= FULL * F.col("page_width"))
    both = slim.join(column_cuts(slim.where("narrow")), list(PAGE), "left").withColumn("top", F.min(F.when(F.col("narrow"), F.col("y0"))).over(Window.partitionBy(*PAGE)))
    part = F.when(F.col("at").isNull(), 0).when(F.col("narrow") & (F.col("x0") < F.col("at")), 2).when(F.col("narrow"), 3).when(F.col("y0") < F.col("top"), 1).otherwise(4)
    rows = both.withColumn("part", part).groupBy(*PAGE).agg(F.max(F.col("at").isNotNull()).alias("two_columns"), F.array_sort(F.collect_list(F.struct("part", "y0", "x0", "text"))).alias("b"))
    return rows.select(*PAGE, "two_columns", F.array_join(F.transform("b", lambda b: F.trim(b["text"])), "\n\n").alias("text"))
