"""Mixed timestamp formats and zones: one dictionary of distinct raw values, parsed once, joined back."""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..session import cut, shared_dir, small

KEYS = ("_raw_value", "_raw_zone", "_month_first")
#: Where the dictionary lies in the shared folder; its version is a digest of the grammar, so that another grammar begins another.
DICTIONARY = "sieveline-instants"
VERSION = "v-" + hashlib.md5(inspect.getsource(dates).encode()).hexdigest()[:12]


def with_keys(df: DataFrame, raw: Column, zone: Column, month_first: Column) -> DataFrame:
    """df with the dictionary's key. Zone and order are part of it only where the value depends on them."""
    return df.withColumns(
        {
            "_raw_value": raw,
            "_raw_zone": F.when(dates.needs_zone(raw), F.coalesce(zone, F.lit("UTC"))).otherwise(F.lit("")),
            "_month_first": dates.is_slashed(raw) & F.coalesce(month_first, F.lit(False)),
        }
    )


def update_dictionary(keyed: DataFrame, path: str) -> DataFrame:
    """Parse the keys of ``keyed`` that the dictionary at ``path`` lacks, append them and return the entries of its keys.

    Keys with a null or blank raw value are not kept. What a key denotes depends on nothing else, so a dictionary serves
    all tables; writers that come at the same time may both add a key, which then counts once. A batch that fails leaves
    no files behind.
    """
    spark = keyed.sparkSession
    target = f"{path.rstrip('/')}/{VERSION}"
    asked = cut(keyed.select(*KEYS).where(F.col("_raw_value").isNotNull() & (F.length(dates.tidy(F.col("_raw_value"))) > 0)).distinct())
    fresh = asked
    try:
        fresh = asked.join(spark.read.parquet(target), list(KEYS), "left_anti")
    except Exception as error:  # no dictionary yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    parsed = dates.with_instant(fresh, *KEYS).withColumn("is_open", dates.is_open(F.col("_raw_value")))
    parsed.write.mode("append").parquet(target)
    return spark.read.parquet(target).join(asked, list(KEYS), "left_semi").groupBy(*KEYS).agg(F.max("instant").alias("instant"), F.max("is_open").alias("is_open"))


def normalise(df: DataFrame, raw: str, zone: str | None = None, month_first: str | None = None, path: str | None = None) -> DataFrame:
    """df with ``instant`` (timestamp) and ``is_open`` (an "until now" word) for its column ``raw``.

    Every row comes back once, in any order; null, blank and unreadable values get a null instant and false.
    ``path`` names the dictionary to go on from; without it it is the one in the shared folder, which later calls go on from.
    Columns of df named like the added ones are replaced.
    """
    df = df.drop(*{"instant", "is_open", *KEYS} - {raw})
    keyed = cut(with_keys(df, F.col(raw), F.col(zone) if zone else F.lit(None).cast("string"), F.col(month_first) if month_first else F.lit(False)))
    book = cut(update_dictionary(keyed, path or f"{shared_dir(df.sparkSession).rstrip('/')}/{DICTIONARY}"))
    return keyed.join(small(book), list(KEYS), "left").drop(*KEYS).withColumn("is_open", F.coalesce("is_open", F.lit(False)))


def slash_order(values: Column) -> Column:
    """True if an array of raw values shows that dates with slashes have the month first; null elements are passed over.

    One first number over 12 means day first; else one second number over 12 means month first; else day first.
    """
    part = lambda x, g: F.regexp_extract(dates.tidy(x), dates.SLASHED, g).try_cast("int")
    slashed = F.filter(values, lambda x: F.contains(x, F.lit("/")))
    day = F.exists(slashed, lambda x: F.coalesce(part(x, 1) > 12, F.lit(False)))
    month = F.exists(slashed, lambda x: F.coalesce(part(x, 2) > 12, F.lit(False)))
    return F.coalesce(~day & month, F.lit(False))


def job_sides(resumes: DataFrame, *keep: str) -> DataFrame:
    """One row per job and side of resumes: candidate_id, item_no, side, raw, zone, month_first and ``keep``; repeated rows once."""
    jobs = F.transform("experience", lambda x: F.struct(x["start_date_raw"].alias("start"), x["end_date_raw"].alias("end")))
    slim = resumes.select("candidate_id", *keep, F.col("office_zone").alias("zone"), jobs.alias("jobs")).distinct()
    raws = F.flatten(F.transform("jobs", lambda x: F.array(x["start"], x["end"])))
    slim = slim.select("candidate_id", *keep, "zone", slash_order(raws).alias("month_first"), F.posexplode("jobs").alias("item_no", "job"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col("job")[s].alias("raw")) for s in ("start", "end")]))
    return slim.select("candidate_id", *keep, "item_no", "zone", "month_first", sides.alias("x")).select("candidate_id", *keep, "item_no", "zone", "month_first", "x.*")


def resume_instants(resumes: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """candidate_id, item_no, side, raw, instant, is_open of every start and end of resumes.experience."""
    return normalise(job_sides(resumes, *keep), "raw", "zone", "month_first", path).drop("zone", "month_first")


def found(resumes: DataFrame) -> DataFrame:
    """candidate_id, item_no, side, utc of every value that denotes a date.

    Null, blank and unreadable values, fillers and "until now" words, however long, give no row, and neither do null or
    empty lists of jobs. A null office_zone is UTC. Repeated rows of a resume count once; a null candidate_id is kept as
    it is. Other columns are not read. An empty table gives an empty result.
    """
    rows = resume_instants(resumes).where(F.col("instant").isNotNull())
    return rows.select("candidate_id", "item_no", "side", dates.utc_text(F.col("instant")).alias("utc")).distinct()
