"""Functions on arrays: keep-first, splitting of requirement lines, and what is made of both. Order is that of the input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import guard_norm, norm, strip, supports, text_or_empty

_NONE = "array<string>"

# Openings of requirement lines that say nothing; at most one is taken off.
FILLERS = (
    r"hands[- ]on experience (?:with|in|building)\s+", r"strong understanding of\s+", r"strong knowledge of\s+", r"solid understanding of\s+", r"deep understanding of\s+", r"working knowledge of\s+", r"proven experience (?:with|in)\s+",
    r"demonstrated experience (?:with|in)\s+", r"experience working (?:with|in)\s+", r"experience (?:with|in|using|building|supporting)\s+", r"familiarity with\s+", r"exposure to\s+", r"knowledge of\s+",
    r"understanding of\s+", r"proficiency (?:with|in)\s+", r"expertise (?:with|in)\s+", r"comfort(?:able)? working with\s+", r"ability to\s+", r"strong\s+", r"good\s+",
)
# Patterns of clauses that hold no skill, and of words inside a list that is no list.
YEARS = r"(?i)^\s*\d+[+-]?\s*(?:to|-)?\s*\d*\+?\s*years?\s+of\s+experience"
EDUCATION = (
    r"(?i)^\s*(?:must have |requires |required: |education: |minimum |degree in )?(?:bachelor(?:'s)?|master(?:'s)?|b\.?\s*tech|m\.?\s*tech|b\.?\s*e\.?|b\.?\s*s\.?|b\.?\s*sc|m\.?\s*s\.?|m\.?\s*sc|mba|mca|bca|ph\.?d|degree|diploma)\b"
)
TOGETHER = r"(?i)^(?:ability to\s+|experience\s+)?collaborat\w*\s+(?:closely\s+|effectively\s+|cross[- ]functionally\s+)?with\b"
PEOPLE = r"(?i)^(?:[A-Za-z]+\s+)?(?:engineers?|developers?|scientists?|analysts?|managers?|teams?|stakeholders?|leads?|panelists?|members?)$"
HEDGE = r"(?i)^(?:similar|equivalent|comparable|related|other|such)\b"
PREPOSITION = r"(?i)\b(?:for|with|in|of|using|on)\b"
SKILL_LABEL = r"(?i)skill|technolog|tool|stack|language|framework|pipeline|engineering|database"
LABELLED = r"^\s*([A-Za-z][A-Za-z0-9 &/\-]{1,40}):\s*(.+)$"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}|\d{4}"
# A line with a company, and under it one with its dates.
COMPANY_DATES = rf"(?im)^\s*([A-Z][A-Za-z0-9&.,'’\- ]{{2,60}}?)\s*\n\s*(?:{_MONTH})\s*[-–—]+\s*(?:{_MONTH}|present|current|till date|ongoing)"
_FILLER = "(?i)^(?:" + "|".join(FILLERS) + ")"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def keep_first(items: Column, key=norm) -> Column:
    """Items with a key of their own, in the casing that came first; nulls and blanks go."""
    kept = F.filter(or_empty(items), lambda x: F.length(strip(text_or_empty(x))) > 0)
    start = F.struct(F.array().cast(_NONE).alias("keys"), F.array().cast(_NONE).alias("vals"))

    def step(s: Column, x: Column) -> Column:
        k = key(x)
        new = ~F.array_contains(s["keys"], k)
        return F.struct(F.when(new, F.array_append(s["keys"], k)).otherwise(s["keys"]).alias("keys"), F.when(new, F.array_append(s["vals"], x)).otherwise(s["vals"]).alias("vals"))

    return F.aggregate(kept, start, step, lambda s: s["vals"])


def without_filler(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), _FILLER, ""))


def split_enumeration(c: Column) -> Column:
    """The parts of a list with "and" or "or" (written small), or null where splitting is not safe."""
    joined = F.regexp_replace(F.regexp_replace(strip(c), r"\.+$", ""), r"\s*,?\s+(?:and|or)\s+", ", ")
    parts = F.filter(F.transform(F.split(joined, ","), strip), lambda p: F.length(p) > 0)
    safe = c.rlike(r"(?i)\b(?:and|or)\b") & (F.size(parts) >= 2) & ~F.exists(parts, lambda p: p.rlike(PREPOSITION))
    return F.when(safe, parts)


def atomize_line(c: Column) -> Column:
    """The skills a requirement line names: none for clauses on years, degrees and people, the line itself where it cannot be split."""
    line = strip(text_or_empty(c))
    drop = (F.length(line) == 0) | line.rlike(YEARS) | line.rlike(EDUCATION) | line.rlike(TOGETHER)
    core = strip(F.regexp_replace(without_filler(line), r"\.+$", ""))
    items = F.when(F.length(core) == 0, F.array().cast(_NONE)).otherwise(F.coalesce(split_enumeration(core), F.array(core)))
    clean = lambda x: F.regexp_replace(F.regexp_replace(without_filler(x), r"(?i)\s+skills?\s*$", ""), r"^[ .]+|[ .]+$", "")
    good = F.filter(F.transform(items, clean), lambda x: (F.length(x) > 0) & ~x.rlike(PEOPLE) & ~x.rlike(HEDGE))
    return F.when(drop, F.array().cast(_NONE)).otherwise(good)


def atomize(items: Column) -> Column:
    return keep_first(F.flatten(F.transform(or_empty(items), atomize_line)))


def split_dense(c: Column) -> Column:
    """Tokens of a labelled line: split on commas and ampersands, without clauses and without more than three words."""
    trim = lambda x: F.regexp_replace(strip(x), r"^[ .]+|[ .]+$", "")
    parts = F.transform(F.split(text_or_empty(c), "[,&]"), lambda p: trim(F.regexp_replace(trim(p), r"(?i)^(?:and|or)\s+", "")))
    return F.filter(parts, lambda p: (F.length(p) > 0) & ~p.rlike(PREPOSITION) & (F.size(F.split(p, r"\s+")) <= 3))


def labelled_tokens(text: Column) -> Column:
    """Tokens of all lines whose label sounds of skills, each once."""
    lines = F.filter(F.transform(F.split(text_or_empty(text), r"\r?\n|\r"), strip), lambda x: x.rlike(LABELLED) & F.regexp_extract(x, LABELLED, 1).rlike(SKILL_LABEL))
    return keep_first(F.flatten(F.transform(lines, lambda x: split_dense(F.regexp_extract(x, LABELLED, 2)))), guard_norm)


def recovered(text: Column, known: Column) -> Column:
    """labelled_tokens that are not among the known ones."""
    have = F.transform(or_empty(known), guard_norm)
    return F.filter(labelled_tokens(text), lambda t: ~F.array_contains(have, guard_norm(t)))


def technologies(c: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(c, F.array()), lambda e: or_empty(e["technologies_used"])))


def all_skills(skills: Column, experience: Column, projects: Column, certifications: Column) -> Column:
    """Skills, then tools of jobs and of projects, then what certificates list after a colon; each once, first casing kept."""
    listed = F.filter(or_empty(certifications), lambda x: F.contains(x, F.lit(":")))
    after = F.flatten(F.transform(listed, lambda x: split_dense(F.regexp_replace(x, r"^[^:]*:", ""))))
    return keep_first(F.concat(or_empty(skills), technologies(experience), technologies(projects), after))


def unused_skills(skills: Column, used: Column) -> Column:
    """Skills that are not among the used ones, apart from case."""
    have = F.transform(or_empty(used), norm)
    return F.filter(or_empty(skills), lambda s: ~F.array_contains(have, norm(s)))


def grounded(items: Column, text: Column) -> Column:
    """Items that a text bears out; text is guard_norm'ed."""
    return F.filter(or_empty(items), lambda i: supports(i, text))


def dedupe_jobs(experience: Column) -> Column:
    """Jobs that differ in title, company, dates or description (white space and case aside), first ones kept. Each key is made once."""
    key = lambda e: F.concat_ws("\u0001", *[guard_norm(e[f]) for f in ("title", "company", "start_date_raw", "end_date_raw", "description")])
    start = F.struct(F.array().cast(_NONE).alias("keys"), F.slice(experience, 1, 0).alias("jobs"))

    def step(s: Column, e: Column) -> Column:
        return F.struct(F.array_append(s["keys"], key(e)).alias("keys"), F.array_append(s["jobs"], e).alias("jobs"))

    def first(s: Column) -> Column:
        return F.filter(s["jobs"], lambda _, i: F.array_position(s["keys"], F.get(s["keys"], i)) == i + 1)

    return F.aggregate(experience, start, step, first)


def titles(summary: Column, experience: Column) -> Column:
    """The title a summary states, then those of the jobs, each once."""
    return keep_first(F.concat(F.array(summary), F.transform(F.coalesce(experience, F.array()), lambda e: strip(text_or_empty(e["title"])))))


def dropped_companies(text: Column, companies: Column) -> Column:
    """Company lines followed by a line of dates that are not among the companies, sorted."""
    names = F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(COMPANY_DATES), F.lit(1)), lambda n: F.regexp_replace(strip(n), r"\s+", " "))
    names = F.filter(names, lambda n: (F.size(F.split(n, r"\s+")) <= 6) & (F.length(n) > 0))
    have = F.filter(F.transform(or_empty(companies), guard_norm), lambda c: F.length(c) > 0)
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~F.exists(have, lambda c: F.contains(guard_norm(n), c) | F.contains(c, guard_norm(n))))))


