"""Scalar text functions as column expressions: nulls are read as empty texts unless said otherwise."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that do not count in titles and in role queries.
TITLE_STOPWORDS = ("the", "a", "an", "of", "and", "for")
ROLE_STOPWORDS = ("the", "a", "an", "for", "role", "position", "job", "opening")
# Degree words by tier, in the order they are looked for.
DEGREE_TIERS = (
    ("bachelor", ("bachelor", "btech", "be", "bs", "bsc", "bca", "undergraduate", "ug")),
    ("master", ("master", "mtech", "me", "ms", "msc", "mca", "mba", "postgraduate", "pg")),
    ("phd", ("phd", "doctorate")),
    ("diploma", ("diploma", "associate")),
)
# What makes a field of study open to all.
OPEN_FIELDS = ("any", "related field", "relevant field", "all fields")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """White space of any kind off both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    return F.lower(strip(text_or_empty(c)))


def slugify(c: Column, empty: str = "unknown-role") -> Column:
    """Lower case, runs of other signs than letters and digits as one hyphen, none at the ends; ``empty`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(norm(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit(empty))


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, repeated ones kept."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def word_set(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    return F.array_except(words(c), F.array(*[F.lit(w) for w in stopwords]).cast("array<string>"))


def guard_norm(c: Column) -> Column:
    """Curly quotes and dashes as ASCII, white space collapsed, lower case."""
    plain = F.translate(text_or_empty(c), "“”‘’–—", "\"\"''--")
    return F.regexp_replace(F.lower(strip(plain)), r"(?U)\s+", " ")


def containment_norm(c: Column) -> Column:
    """Lower case with hyphens, slashes, brackets and commas as spaces, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), r"[-_/(),]", " "), r"(?U)\s+", " "))


def contains_word(haystack: Column, needle: Column) -> Column:
    """Whether the needle, as it stands, occurs between no letters or digits; an empty one never does. Both in lower case."""
    bounded = F.regexp_like(haystack, F.concat(F.lit(r"(?<![a-z0-9])\Q"), needle, F.lit(r"\E(?![a-z0-9])")))
    return F.coalesce((F.length(needle) > 0) & F.contains(haystack, needle) & bounded, F.lit(False))


def supports(item: Column, text: Column) -> Column:
    """Whether a text bears an item out: the whole phrase at word bounds, or all of several words in any order. ``text`` is guard_norm'ed."""
    phrase = guard_norm(item)
    parts = F.split(phrase, " ")
    each = (F.size(parts) > 1) & F.forall(parts, lambda w: contains_word(text, w))
    return (F.length(phrase) > 0) & (contains_word(text, phrase) | each)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def phrase_in(phrase: Column, source: Column) -> Column:
    """Whether a phrase stands in a source, both containment_norm'ed here; nothing is in everything."""
    p = containment_norm(phrase)
    return (F.length(p) == 0) | F.contains(containment_norm(source), p)


def quoted_phrases(c: Column) -> Column:
    """What stands between single or double quotes, straight or curly, 2 to 80 signs long, in order."""
    both = F.regexp_extract_all(text_or_empty(c), F.lit("(['‘’][^'‘’]{2,80}['‘’]|[\"“”][^\"“”]{2,80}[\"“”])"), F.lit(1))
    return F.transform(both, lambda p: strip(F.substring(p, 2, F.length(p) - 2)))


def false_citation(reason: Column, evidence: Column, title: Column) -> Column:
    """The first phrase that a reason takes from a title though the evidence does not hold it, or null.

    Looked at are quoted phrases, then parts of the title of two words or more, then the whole title.
    """
    many = lambda s: F.size(F.split(strip(s), r"\s+")) >= 2
    parts = F.filter(F.transform(F.split(text_or_empty(title), r"[—\-/|]"), strip), many)
    whole = F.filter(F.array(strip(text_or_empty(title))), many)
    phrases = F.filter(F.concat(quoted_phrases(reason), parts, whole), lambda p: F.length(p) > 0)
    wrong = F.filter(phrases, lambda p: ~phrase_in(p, evidence) & phrase_in(p, reason) & phrase_in(p, title))
    return F.try_element_at(wrong, F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over their common length; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((n > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def initials(c: Column) -> Column:
    """The first letters of the first two words in capitals; ? for no name."""
    heads = F.transform(F.slice(F.split(strip(c), r"(?U)\s+"), 1, 2), lambda w: F.upper(F.substring(w, 1, 1)))
    return F.when(F.length(text_or_empty(c)) > 0, F.array_join(heads, "")).otherwise(F.lit("?"))


def format_education(c: Column) -> Column:
    """Each degree as "level — field", joined by commas; — for none."""
    kept = lambda *xs: F.filter(F.array(*xs), lambda v: F.length(text_or_empty(v)) > 0)
    return F.when(F.size(F.coalesce(c, F.array())) > 0, F.array_join(F.transform(c, lambda e: F.array_join(kept(e["degree_level"], e["field"]), " — ")), ", ")).otherwise(F.lit("—"))


def degree_tier(c: Column) -> Column:
    """The first tier one of whose words occurs anywhere in the text without its punctuation; other for none."""
    s = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]", "")
    out = None
    for tier, keys in DEGREE_TIERS:
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(s, F.lit(k))
        out = F.when(hit, F.lit(tier)) if out is None else out.when(hit, F.lit(tier))
    return out.otherwise(F.lit("other"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9\s]", " ")


def field_overlap(required: Column, education: Column) -> Column:
    """Whether a required field is open, or one of its alternatives occurs in a degree, as a phrase or word by word."""
    req = strip(_bare(required))
    free = F.length(req) == 0
    for word in OPEN_FIELDS:
        free = free | F.contains(req, F.lit(word))
    keys = F.filter(F.transform(F.split(req, r"\bor\b|\band\b"), strip), lambda k: F.length(k) >= 2)
    texts = F.transform(F.coalesce(education, F.array().cast("array<struct<degree_level:string,field:string,institution:string>>")), lambda e: _bare(F.concat(text_or_empty(e["degree_level"]), F.lit(" "), text_or_empty(e["field"]))))
    hit = F.exists(keys, lambda k: F.exists(texts, lambda t: F.contains(t, k) | F.forall(F.split(k, r"\s+"), lambda w: F.contains(t, w))))
    return free | hit


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched signs over all signs, as the longest-match recursion finds them; a is the first sequence. For distinct pairs."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Rounding of the exact binary value, halves to even: other than both of Spark's roundings where the decimal text ends in 5.

    Whether a double lies above, on or below a half is told without error: its upper and lower halves of bits are scaled
    apart, and what they differ by from the half is exact. For values up to 2**30 and up to 6 digits.
    """
    scale, fine = float(10**digits), float(10 ** (digits + 1))
    size = F.abs(x)
    wide = size * F.lit(134217729.0)  # 2**27 + 1 parts the bits
    high = wide - (wide - size)
    tenths = F.rint(size * F.lit(fine))
    off = (high * F.lit(fine) - tenths) + (size - high) * F.lit(fine)
    low = F.floor(tenths / 10.0).cast("double")
    last = tenths - low * 10.0
    up = F.when(last != 5.0, last > 5.0).when(off != 0.0, off > 0.0).otherwise(F.pmod(low, F.lit(2.0)) == 1.0)
    return F.signum(x) * (low + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
