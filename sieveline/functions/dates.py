"""Reading of dates as people write them, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names by number, English, German, French, Spanish, with usual short forms.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fevr febrero",
    3: "march mar märz maerz mrz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
# Words for "until now".
OPEN_WORDS = (
    "present", "current", "currently", "now", "today", "date", "to date", "till date", "till now", "until now", "up to now",
    "ongoing", "on going", "to present", "till present", "until present", "to now", "heute", "bis heute", "jetzt", "laufend",
    "aktuell", "actuel", "actuellement", "aujourd'hui", "à ce jour", "en cours", "actual", "actualidad", "hasta hoy", "presente",
)
# Zone abbreviations and their offsets.
ABBREVIATIONS = {"Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "CET": "+01:00", "CEST": "+02:00", "BST": "+01:00", "EST": "-05:00", "EDT": "-04:00"}

NAME = r"([\p{L}]{3,10})"
_TIME = r"(?:(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([AaPp][Mm])(?![A-Za-z]))?(?:\s*(Z|[+-]\d{2}:?\d{2}|[A-Z]{3,4}|[A-Za-z]+/[A-Za-z_/+-]+))?)?$"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?!\d)"
#: What a date looks like before its time: pattern, and the groups of year, month and day (0: absent).
SHAPES = (
    (r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})", 1, 2, 3),
    (r"^(\d{4})[-./](\d{1,2})", 1, 2, 0),
    (r"^((?:19|20)\d{2})(\d{2})(\d{2})", 1, 2, 3),
    (r"^((?:19|20)\d{2})", 1, 0, 0),
    (r"^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})", 3, 2, 1),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})", 3, 2, 1),
    (r"^(\d{1,2})[-./](\d{4})", 2, 1, 0),
    (rf"^(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]*{NAME}[.,]?[\s-]*(\d{{4}})", 3, 2, 1),
    (rf"^{NAME}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", 3, 1, 2),
    (rf"^{NAME}[.,]?[\s/-]*(\d{{4}})", 2, 1, 0),
    (rf"^{NAME}[.,]?[\s/-]*['’]?(\d{{2}})", 2, 1, 0),
)


def tidy(raw: Column) -> Column:
    """Outer white space gone, inner runs one space."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", " "), r"^ | $", "")


def month_number(name: Column) -> Column:
    pairs = [F.lit(x) for n, names in MONTHS.items() for word in names.split() for x in (word, n)]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def is_open(raw: Column) -> Column:
    """Whether a value says "until now"."""
    return F.coalesce(F.lower(F.regexp_replace(tidy(raw), r"[.!]+$", "")).isin(*OPEN_WORDS), F.lit(False))


def needs_zone(raw: Column) -> Column:
    """Whether a value has a time but no zone of its own."""
    return F.coalesce(F.contains(raw, F.lit(":")) & tidy(raw).rlike(r"\d(?:T|,?\s+)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[AaPp][Mm])?$"), F.lit(False))


def is_slashed(raw: Column) -> Column:
    return F.coalesce(F.contains(raw, F.lit("/")) & tidy(raw).rlike(SLASHED), F.lit(False))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def region_zones(spark: SparkSession) -> list[str]:
    """The region-based zone names the executors know."""
    return sorted(z for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)


def with_instant(df: DataFrame, raw: str, zone: str, month_first: str) -> DataFrame:
    """df with ``instant``, what the raw value denotes, or null.

    A missing month, day or time is the first and midnight, and values without a time are not shifted.
    A two-digit number after a month name is a year 20yy. ``zone`` holds for times without a zone;
    ``month_first`` is the order of dates with slashes. Skipped local times move on by the gap, repeated
    ones are the earlier. Nulls, blanks and anything that matches no shape give null.
    """
    t, kept = F.col("_t"), df.columns
    made = lambda y, m, d, rest: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), rest.alias("rest"))
    a, b = (_int(F.regexp_extract(t, SLASHED, g)) for g in (1, 2))
    swap = F.when(a > 12, F.lit(False)).when(b > 12, F.lit(True)).otherwise(F.col(month_first))
    chain = F.when(
        t.rlike(SLASHED + _TIME),
        made(_int(F.regexp_extract(t, SLASHED, 3)), F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a), F.regexp_replace(t, SLASHED, "")),
    )
    for pattern, y, m, d in SHAPES:
        month = F.lit(1)
        if m:
            text = F.regexp_extract(t, pattern, m)
            month = month_number(text) if NAME in pattern else _int(text)
        day = _int(F.regexp_extract(t, pattern, d)) if d else F.lit(1)
        chain = chain.when(t.rlike(pattern + _TIME), made(_int(F.regexp_extract(t, pattern, y)), month, day, F.regexp_replace(t, pattern, "")))
    part = lambda g: F.regexp_extract("_ymd.rest", "^" + _TIME, g)
    df = df.withColumn("_t", tidy(F.col(raw))).withColumn("_ymd", chain)
    df = df.withColumn("_clock", F.struct(_int(part(1)).alias("h"), _int(part(2)).alias("mi"), _int(part(3)).alias("s"), F.lower(part(4)).alias("half"), part(5).alias("said")))
    said, hour, half = F.col("_clock.said"), F.col("_clock.h"), F.col("_clock.half")
    offset = F.try_element_at(F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair]), said)
    numeric = F.regexp_replace(said, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    own = F.when(hour.isNull(), F.lit("UTC")).when(F.length(said) == 0, F.coalesce(F.col(zone), F.lit("UTC")))
    own = own.when(said.rlike(r"^[+-](0\d|1[0-7]):?[0-5]\d$"), numeric).otherwise(F.coalesce(offset, said))
    df = df.withColumn("_own", own)
    known = F.split(F.lit(" ".join(region_zones(df.sparkSession))), " ")
    own = F.col("_own")
    fine = (own == "UTC") | own.rlike(r"^[+-]\d{2}:\d{2}$") | F.array_contains(known, own)
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    y = F.when(F.col("_ymd.y") < 100, F.col("_ymd.y") + 2000).otherwise(F.col("_ymd.y"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    dated = F.try_make_timestamp(y, F.col("_ymd.m"), F.col("_ymd.d"), zero(hour), zero(F.col("_clock.mi")), zero(F.col("_clock.s")).cast("decimal(16,6)"), own)
    number = t.try_cast("bigint")
    instant = (
        F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(number))
        .when(t.rlike(r"^\d{12,13}$"), F.timestamp_millis(number))
        .when(F.col("_ymd.m").between(1, 12) & fine, dated)
    )
    return df.withColumn("instant", instant).select(*kept, "instant")


def utc_text(instant: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """UTC rendering whatever the session's zone is."""
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), pattern)


def utc_day(instant: Column) -> Column:
    return F.to_date(F.to_utc_timestamp(instant, F.current_timezone()))
