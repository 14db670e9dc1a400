"""Overlapping and gapped intervals, by a range sort, summaries of partitions, their prefix and a rescan.

No entity is ever gathered in one task: the rows are range-partitioned by entity and start, so that an entity with a
third of all rows spreads over as many partitions as its rows need. What crosses partitions is one row of each.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..session import cut, range_parts, ship
from . import timestamps

def island_parts(df: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Parts of islands: entity, lo, hi (int), label. A partition gives one row for each island it holds a part of."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi"))
    rows = rows.where("entity is not null and lo is not null and hi is not null and lo <= hi")
    rows = cut(rows)
    n = partitions or range_parts(rows)
    rows = cut(rows.repartitionByRange(n, "entity", "lo", "hi").sortWithinPartitions("entity", "lo", "hi")).withColumn("pid", F.spark_partition_id())
    summaries = rows.groupBy("pid").agg(F.min("entity").alias("head"), F.max(F.struct("entity", "hi")).alias("tail"))
    told = summaries.select("pid", F.col("tail.entity").alias("entity"), F.col("tail.hi").alias("hi"), F.lit(False).alias("asks"))
    asked = summaries.select("pid", F.col("head").alias("entity"), F.lit(None).cast("long").alias("hi"), F.lit(True).alias("asks"))
    before = Window.partitionBy("entity").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    carried = told.unionByName(asked).withColumn("carry", F.max("hi").over(before)).where("asks and carry is not null")
    state = {r["pid"]: (r["entity"], r["carry"]) for r in carried.collect()}  # at most one row per partition

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, high, count, pid = None, None, 0, None
        for b in batches:
            if b.empty:
                continue
            if pid is None:
                pid = int(b["pid"].iloc[0])
                name, high = state.get(pid, (None, None))
            who = b["entity"].to_numpy()
            lo, hi = b["lo"].to_numpy(), b["hi"].to_numpy()
            turn = np.empty(len(b), bool)
            turn[0] = who[0] != name
            turn[1:] = who[1:] != who[:-1]
            group = np.cumsum(turn)
            base = hi.min() if turn[0] else min(hi.min(), high)
            shift = group * (max(hi.max(), base if turn[0] else high) - base + 1)  # keeps the running maxima of entities apart
            own = hi - base + shift
            if not turn[0]:
                own[0] = max(own[0], high - base + shift[0])
            top = np.maximum.accumulate(own) - shift + base
            seen = np.empty(len(b), np.int64)
            seen[1:] = top[:-1]
            seen[0] = high if not turn[0] else 0
            fresh = turn | (lo > seen)
            local = count + np.cumsum(fresh)
            out = pd.DataFrame({"pid": pid, "local": local, "entity": who, "lo": lo, "hi": hi, "n": 1}).groupby("local", sort=False)
            yield out.agg(pid=("pid", "first"), entity=("entity", "first"), lo=("lo", "min"), hi=("hi", "max"), n=("n", "sum")).reset_index()
            name, high, count = who[-1], int(top[-1]), int(local[-1])

    parts = cut(rows.mapInPandas(rescan, "local long, pid int, entity string, lo long, hi long, n long"))
    begun = parts.groupBy("pid").agg(F.max("local").alias("begun"))
    offsets = begun.withColumn("base", F.coalesce(F.sum("begun").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(offsets.select("pid", "base")), "pid").select("entity", "lo", "hi", "n", (F.col("base") + F.col("local")).alias("label"))


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """The continuous stretches of each entity: entity, label, lo, hi (whole numbers, as start and end cast to long), n rows.

    Intervals that touch are one stretch. Rows with a null or with end before start are left out; repeated rows change
    nothing but n; an empty table gives an empty result. Labels count up in the order of entity and start, without holes.
    """
    return island_parts(df, entity, start, end, partitions).groupBy("label", "entity").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def gaps(islands: DataFrame) -> DataFrame:
    """Between each stretch and the next of the same entity: entity, label, lo, hi. Labels are neighbours, so no entity is gathered."""
    after = islands.select((F.col("label") - 1).alias("label"), F.col("entity").alias("next_entity"), F.col("lo").alias("next_lo"))
    both = islands.join(after, "label").where(F.col("entity") == F.col("next_entity"))
    return both.select("entity", "label", F.col("hi").alias("lo"), F.col("next_lo").alias("hi"))


def repair_jobs(jobs: DataFrame, as_of: dt.date) -> DataFrame:
    """Jobs (candidate_id, lo, hi, days since 1970) that count, after the rules for open, reversed and future ones."""
    today = (as_of - dt.date(1970, 1, 1)).days
    starts = jobs.where("lo is not null").groupBy("candidate_id", "lo").agg(F.sum(F.col("hi").isNull().cast("int")).alias("open"))
    latest = starts.groupBy("candidate_id").agg(F.max(F.struct("lo", "open")).alias("last"))
    latest = latest.where("last.open = 1").select("candidate_id", F.col("last.lo").alias("open_lo"))
    full = jobs.where("lo is not null").join(latest, "candidate_id", "left")
    full = full.withColumn("hi", F.when(F.col("hi").isNull() & (F.col("lo") == F.col("open_lo")), F.lit(today)).otherwise(F.col("hi")))
    return full.where(F.col("hi").isNotNull() & (F.col("hi") >= F.col("lo")) & (F.col("lo") <= today)).select("candidate_id", "lo", F.least("hi", F.lit(today)).alias("hi"))


def experience_jobs(resumes: DataFrame, as_of: dt.date) -> DataFrame:
    """candidate_id, item_no, lo, hi of every job, in days since 1970; hi of an "until now" word is as_of."""
    sides = timestamps.resume_instants(resumes)
    day = F.when(F.col("is_open"), F.when(F.col("side") == "end", F.lit(as_of))).otherwise(dates.utc_day(F.col("instant")))
    day = F.unix_date(day)
    pick = lambda side: F.max(F.when(F.col("side") == side, day))
    return sides.groupBy("candidate_id", "item_no").agg(pick("start").alias("lo"), pick("end").alias("hi"))


def found(resumes: DataFrame, as_of: dt.date = dt.date(2025, 7, 1)) -> DataFrame:
    """candidate_id, kind (period, gap, total), from_date, to_date: the stretches and gaps of resumes.experience, and wrong totals.

    Null or empty lists of jobs, null dates and a null candidate_id give no rows; a null total is never wrong. Jobs that
    agree in both dates are kept apart until the open one is looked for, then count once. Repeated rows of a resume count
    once. Other columns are not read. An empty table gives an empty result.
    """
    jobs = repair_jobs(cut(experience_jobs(resumes, as_of)), as_of)
    islands = cut(merge_intervals(jobs, "candidate_id", "lo", "hi"))
    spans = islands.groupBy("entity").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("hi") - F.col("lo")).alias("days"))
    totals = resumes.select(F.col("candidate_id").alias("entity"), "total_years_experience").where("total_years_experience is not null").distinct()
    wrong = spans.join(totals, "entity").where(F.abs(F.col("total_years_experience") - F.col("days") / 365.25) > 0.3)
    day = lambda c: F.date_format(F.date_from_unix_date(F.col(c).cast("int")), "yyyy-MM-dd")
    shaped = lambda df, kind: df.select(F.col("entity").alias("candidate_id"), F.lit(kind).alias("kind"), day("lo").alias("from_date"), day("hi").alias("to_date"))
    return shaped(islands, "period").unionByName(shaped(gaps(islands), "gap")).unionByName(shaped(wrong, "total"))
