"""Queries of the general data-preparation operators: intervals, timestamps, packed fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..functions import dates
from ..operators import intervals, packed, timestamps
from ..session import table


#: The day that stands for "today".
AS_OF = dt.date(2025, 7, 1)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.found(table(spark, sf_dir, "resumes"), AS_OF)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found(table(spark, sf_dir, "resumes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.found({name: table(spark, sf_dir, name) for name in ("resumes", "jds")}, table(spark, sf_dir, "skill_ref").select("skill"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p7_found": p7_found}


def _instants() -> str:
    """SQL of the raw dates of resumes with their instants (u, in UTC) and whether they say "until now" (open)."""
    months = "MAP {" + ", ".join(f"'{word}': {n}" for n, names in dates.MONTHS.items() for word in names.split()) + "}"
    zones = "MAP {" + ", ".join(f"'{z}': {int(o[:3]) * 60}" for z, o in dates.ABBREVIATIONS.items()) + "}"
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in dates.OPEN_WORDS)

    def shape(group: int) -> str:
        """The year, month or day (1 to 3) of the first shape that the date part has as a whole."""
        out = ""
        for pattern, *groups in dates.SHAPES:
            q, g = "'" + pattern.replace("'", "''") + "$'", groups[group - 1]
            text = f"regexp_extract(d, {q}, {g})"
            value = "1" if not g else f"{months}[lower({text})]" if group == 2 and dates.NAME in pattern else f"TRY_CAST({text} AS INTEGER)"
            out += f" WHEN regexp_matches(d, {q}) THEN {value}"
        return out

    slashed = "^(\\d{1,2})/(\\d{1,2})/(\\d{4}|\\d{2})$"
    part = lambda x, g: f"TRY_CAST(regexp_extract(trim({x}), '^(\\d{{1,2}})/(\\d{{1,2}})/\\d', {g}) AS INTEGER)"
    own = lambda g: f"TRY_CAST(regexp_extract(d, '{slashed}', {g}) AS INTEGER)"
    swap = f"CASE WHEN {own(1)} > 12 THEN FALSE WHEN {own(2)} > 12 THEN TRUE ELSE month_first END"
    local = "printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d_, coalesce(hh, 0), coalesce(mi, 0), coalesce(ss, 0))"
    moved = "timezone('UTC', timezone({z}, ts))"
    earlier = f"CASE WHEN timezone({{z}}, timezone({{z}}, ts) - INTERVAL 1 HOUR) = ts THEN {moved} - INTERVAL 1 HOUR ELSE {moved} END"
    region = lambda z: earlier.format(z=z)
    return f"""r AS (SELECT DISTINCT candidate_id, office_zone, experience FROM resumes),
    o AS (SELECT *, list_concat(list_transform(experience, lambda e: e.start_date_raw), list_transform(experience, lambda e: e.end_date_raw)) AS raws FROM r),
    f AS (SELECT candidate_id, coalesce(office_zone, 'UTC') AS z, experience, len(list_filter(raws, lambda x: coalesce({part('x', 1)} > 12, FALSE))) = 0 AND len(list_filter(raws, lambda x: coalesce({part('x', 2)} > 12, FALSE))) > 0 AS month_first FROM o),
    x AS (SELECT candidate_id, z, month_first, generate_subscripts(experience, 1) - 1 AS item_no, unnest(experience) AS e FROM f),
    s AS (SELECT candidate_id, z, month_first, item_no, 'start' AS side, e.start_date_raw AS raw FROM x UNION ALL SELECT candidate_id, z, month_first, item_no, 'end', e.end_date_raw FROM x),
    t AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM s),
    c AS (SELECT *, lower(regexp_replace(t, '[.!]+$', '')) IN ({words}) AS open,
        regexp_extract(t, '^(.*?)(?:(?:T|,? +)(\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}})(?:[.,]\\d+)?)?(?: ?([AaPp][Mm])\\b)?(?: ?(Z|[+-]\\d{{2}}:?\\d{{2}}|[A-Z]{{3,4}}|[A-Za-z]+/[A-Za-z_/+-]+))?)?$', ['d', 'h', 'mi', 's', 'ap', 'zone']) AS k FROM t),
    g AS (SELECT *, k.d AS d, TRY_CAST(k.h AS INTEGER) AS h, TRY_CAST(k.mi AS INTEGER) AS mi, TRY_CAST(k.s AS INTEGER) AS ss, lower(k.ap) AS ap, k.zone AS zone FROM c),
    n AS (SELECT *, CASE ap WHEN 'pm' THEN h % 12 + 12 WHEN 'am' THEN h % 12 ELSE h END AS hh,
        CASE WHEN regexp_matches(d, '{slashed}') THEN {own(3)}{shape(1)} END AS y0,
        CASE WHEN regexp_matches(d, '{slashed}') THEN CASE WHEN {swap} THEN {own(1)} ELSE {own(2)} END{shape(2)} END AS m,
        CASE WHEN regexp_matches(d, '{slashed}') THEN CASE WHEN {swap} THEN {own(2)} ELSE {own(1)} END{shape(3)} END AS d_ FROM g),
    w AS (SELECT *, CASE WHEN y0 < 100 THEN y0 + 2000 ELSE y0 END AS y FROM n),
    v AS (SELECT *, TRY_CAST({local} AS TIMESTAMP) AS ts FROM w),
    i AS (SELECT candidate_id, item_no, side, coalesce(open, FALSE) AS open, CASE
        WHEN regexp_full_match(t, '\\d{{9,10}}') THEN timezone('UTC', to_timestamp(t::BIGINT)) WHEN regexp_full_match(t, '\\d{{12,13}}') THEN epoch_ms(t::BIGINT)
        WHEN ts IS NULL OR h IS NULL THEN ts WHEN zone = '' THEN {region('z')}
        WHEN regexp_matches(zone, '^[+-]') THEN ts - to_minutes(CAST(CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END * (zone[2:3]::INTEGER * 60 + right(zone, 2)::INTEGER) AS BIGINT))
        WHEN map_contains({zones}, zone) THEN ts - to_minutes(CAST({zones}[zone] AS BIGINT)) WHEN contains(zone, '/') THEN {region('zone')} END AS u FROM v)"""


ORACLE: dict[str, str] = {
    "p4_found": f"WITH {_instants()} SELECT DISTINCT candidate_id, item_no::INTEGER AS item_no, side, strftime(u, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM i WHERE u IS NOT NULL",
    "p1_found": f"""WITH {_instants()},
    a AS (SELECT candidate_id, item_no, max(CASE WHEN side = 'start' AND NOT open THEN u::DATE END) AS lo, max(CASE WHEN side = 'end' THEN CASE WHEN open THEN DATE '{AS_OF}' ELSE u::DATE END END) AS hi FROM i GROUP BY 1, 2),
    b AS (SELECT *, max(lo) OVER (PARTITION BY candidate_id) AS latest FROM a WHERE lo IS NOT NULL),
    e AS (SELECT *, count(*) FILTER (WHERE lo = latest AND hi IS NULL) OVER (PARTITION BY candidate_id) AS open FROM b),
    h AS (SELECT candidate_id, lo, CASE WHEN hi IS NULL AND lo = latest AND open = 1 THEN DATE '{AS_OF}' ELSE hi END AS hi FROM e),
    l AS (SELECT DISTINCT candidate_id, lo, least(hi, DATE '{AS_OF}') AS hi FROM h WHERE hi >= lo AND lo <= DATE '{AS_OF}'),
    m AS (SELECT *, max(hi) OVER (PARTITION BY candidate_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
    q AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m),
    p AS (SELECT candidate_id, island, min(lo) AS lo, max(hi) AS hi FROM q GROUP BY 1, 2),
    k AS (SELECT candidate_id, hi AS lo, lead(lo) OVER (PARTITION BY candidate_id ORDER BY island) AS hi FROM p),
    y AS (SELECT candidate_id, min(lo) AS lo, max(hi) AS hi, sum(hi - lo) AS days FROM p GROUP BY 1),
    z AS (SELECT DISTINCT candidate_id, total_years_experience AS total FROM resumes)
    SELECT candidate_id, 'period' AS kind, lo::VARCHAR AS from_date, hi::VARCHAR AS to_date FROM p UNION ALL SELECT candidate_id, 'gap', lo::VARCHAR, hi::VARCHAR FROM k WHERE hi IS NOT NULL
    UNION ALL SELECT y.candidate_id, 'total', lo::VARCHAR, hi::VARCHAR FROM y JOIN z ON y.candidate_id = z.candidate_id WHERE total IS NOT NULL AND abs(total - days / 365.25) > 0.3""",
}
