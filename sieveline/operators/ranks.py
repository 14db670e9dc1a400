"""Places within groups without gathering a group: a range sort, one count a partition and group, and a local rank on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, range_parts, small


def placed(df: DataFrame, by: str, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with ``name``, each row's place (from 1) in its group by ``order``; rows equal in it get places of their own.

    A group with a third of all rows is spread over as many partitions as its rows need. Null groups are one group.
    """
    df = cut(df)
    n = partitions or range_parts(df)
    ranged = cut(df.repartitionByRange(n, F.col(by), *order)).withColumn("_pid", F.spark_partition_id())
    counts = ranged.groupBy(by, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(by).alias("_by"), "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_pid").orderBy(*order)))
    out = local.withColumnRenamed("_pid", "_p").join(small(base), (F.col(by).eqNullSafe(F.col("_by"))) & (F.col("_p") == F.col("_pid")))
    return out.withColumn(name, (F.col("_local") + F.col("_base")).cast("int")).select(*df.columns, name)
