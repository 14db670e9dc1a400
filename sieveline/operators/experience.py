"""Total years of experience from free-text dates, with the warnings of what was left out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_even
from ..session import cut
from .intervals import experience_jobs, merge_intervals, repair_jobs


def total_years(resumes: DataFrame, as_of: dt.date, stated: str | None = None) -> DataFrame:
    """candidate_id, n_jobs, n_used, total_years (1 digit), warnings of each resume; 0 years where no job counts.

    A stated number of years in the column ``stated`` wins if it is greater. Jobs that start after as_of are left out,
    so none counts negatively.
    """
    jobs = cut(experience_jobs(resumes, as_of))
    used = cut(repair_jobs(jobs, as_of))
    days = merge_intervals(used, "candidate_id", "lo", "hi").groupBy(F.col("entity").alias("candidate_id")).agg(F.sum(F.col("hi") - F.col("lo")).alias("days"))
    counts = jobs.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("lo").isNull()).alias("no_start"), F.count_if(F.col("hi").isNull() & F.col("lo").isNotNull()).alias("no_end"), F.count_if(F.col("hi") < F.col("lo")).alias("reversed"))
    out = resumes.select("candidate_id", (F.col(stated) if stated else F.lit(None)).cast("double").alias("stated")).distinct()
    out = out.join(counts, "candidate_id", "left").join(used.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_used")), "candidate_id", "left").join(days, "candidate_id", "left")
    years = round_half_even(F.coalesce("days", F.lit(0)) / 365.25, 1)
    told = [("no_start", "jobs without a readable start"), ("no_end", "jobs without a readable end"), ("reversed", "jobs that end before their start")]
    said = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}"))) for c, text in told] + [F.when(F.col("stated") > years, F.lit("stated years are more than the dates show"))]
    return out.select("candidate_id", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), F.coalesce("n_used", F.lit(0)).alias("n_used"), F.greatest(years, F.coalesce("stated", F.lit(0.0))).alias("total_years"), F.filter(F.array(*said), lambda w: w.isNotNull()).alias("warnings"))
