"""Checks of extracted records against their source text: what the text does not bear out is dropped, with a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import grounded, or_empty
from ..functions.text import guard_norm, supports, text_or_empty

# What a text mentions years and degrees with.
YEARS_MENTION = r"(?i)\b\d{1,2}\s*\+?\s*(?:-|to)?\s*\d{0,2}\s*\+?\s*years?\b"
DEGREE_WORDS = "bachelor master b.tech btech b.e. m.tech mtech b.s. bsc b.sc m.s. msc m.sc mba mca bca phd ph.d degree diploma graduate undergraduate".split()


def guard_resume(df: DataFrame, text: str, fields: tuple[str, ...] = ("skills", "certifications"), title: str | None = None) -> DataFrame:
    """df with ungrounded items of ``fields`` and an ungrounded ``title`` removed, and an array guard_warnings."""
    norm = guard_norm(F.col(text))
    kept = {f: grounded(F.col(f), norm) for f in fields}
    warn = []
    for f in fields:
        lost = F.array_except(or_empty(F.col(f)), kept[f])
        warn.append(F.when(F.size(lost) > 0, F.concat(F.lit(f"{f}: not in the text: "), F.array_join(lost, ", "))))
    out = {f: kept[f] for f in fields}
    if title:
        fine = (F.length(text_or_empty(F.col(title))) == 0) | supports(F.col(title), norm)
        warn.append(F.when(~fine, F.concat(F.lit(f"{title}: not in the text: "), F.col(title))))
        out[title] = F.when(fine, F.col(title)).otherwise(F.lit(""))
    return df.withColumns(out | {"guard_warnings": F.filter(F.array(*warn), lambda w: w.isNotNull())})


def mentions_years(text: Column) -> Column:
    return text_or_empty(text).rlike(YEARS_MENTION)


def mentions_degree(text: Column) -> Column:
    low = F.lower(text_or_empty(text))
    return F.exists(F.array(*[F.lit(w) for w in DEGREE_WORDS]), lambda w: F.contains(low, w))


def guard_jd(df: DataFrame, text: str) -> DataFrame:
    """df with years set to 0 and degree requirements emptied where the text mentions none, and an array guard_warnings."""
    years = (F.col("min_years_experience") > 0) & ~mentions_years(F.col(text))
    degrees = (F.size(F.coalesce("education_requirements", F.array())) > 0) & ~mentions_degree(F.col(text))
    warn = [F.when(years, F.lit("min_years_experience: no years in the text")), F.when(degrees, F.lit("education_requirements: no degree in the text"))]
    return df.withColumns(
        {
            "min_years_experience": F.when(years, 0.0).otherwise(F.col("min_years_experience")),
            "education_requirements": F.when(degrees, F.slice("education_requirements", 1, 0)).otherwise(F.col("education_requirements")),
            "guard_warnings": F.filter(F.array(*warn), lambda w: w.isNotNull()),
        }
    )


def salvage_json(raw: Column, schema: str) -> Column:
    """struct<value, error, raw_output>: parsed JSON, also of the part between the outer braces, else what was there."""
    options = {"mode": "PERMISSIVE"}
    inner = F.regexp_extract(text_or_empty(raw), r"(?s)(\{.*\})", 1)
    fine = F.get_json_object(inner, "$").isNotNull()
    error = F.when(raw.isNull() | (F.length(raw) == 0), F.lit("empty")).when(~fine, F.lit("no JSON"))
    return F.struct(F.when(fine, F.from_json(inner, schema, options)).alias("value"), error.alias("error"), F.when(error == "no JSON", raw).alias("raw_output"))
