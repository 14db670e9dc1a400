"""Several values packed in one field: split into one value per row, with its position.

The text is split on quote marks; odd pieces are literals, even ones are split on delimiters, and a fold over the array
puts the values together again. Everything is expressions on arrays, so no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import small

# Signs and words that separate values.
SIGNS = r",;|/•·\n\r\t&"
WORDS = ("and", "or", "as well as", "und", "oder")

_QUOTE, _CUT = "\u0001", "\u0002"
_OPENS = rf"(?:^|(?<=[{SIGNS}])|(?<=[{SIGNS}]\s)|(?<=[{SIGNS}]\s\s)|(?<=\s(?:and|or|und|oder)\s)|(?<=^\s)|(?<=[*•-]\s)|(?<=\d[.)]\s))"
_CLOSES = rf"(?=\s*(?:$|[{SIGNS}]|(?:and|or|und|oder)\s|\(?\d{{1,2}}[.)]\s))"
# Possessive repetitions run as loops in the JVM, so that the length of a literal takes no stack.
_DOUBLE = rf'{_OPENS}"([^"]*+(?:""[^"]*+)*+)"(?!"){_CLOSES}'
_SINGLE = rf"{_OPENS}'([^']*+(?:(?:''|'(?=\w))[^']*+)*+)'(?!'){_CLOSES}"
_WORD = r"(?i)\s(?:" + "|".join(WORDS) + r")(?=\s|" + _QUOTE + ")"
_NUMBERED = r"^\s*\(?1[.)]\s"
_NUMBER = r"(?:^|\s)\(?\d{1,2}[.)]\s+"
_MARK = r"^\s*[-*•·–]\s+"


def split_packed(text: Column, whole: Column | None = None) -> Column:
    """array<struct<pos:int, val:string>> of the values in ``text``; null gives null, nothing but delimiters an empty array.

    Values are trimmed, lose enclosing quotes (doubled quotes inside become one) and list marks or numbers, and are
    otherwise as typed. Empty ones are skipped and not counted. Where ``whole`` is true nothing is split.
    A quote mark counts only where a value can begin and end, so inch marks and apostrophes are ordinary signs.
    """
    def quoted(t: Column, pattern: str, mark: str) -> Column:
        return F.regexp_replace(t, pattern, f"{_QUOTE}{mark}$1{_QUOTE}")

    # The mark after an opening quote tells which sign was doubled inside: d or s.
    t = quoted(quoted(text, _DOUBLE, "d"), _SINGLE, "s")
    numbered = text.rlike(_NUMBERED)
    pieces = F.split(t, _QUOTE)

    def literal(x: Column) -> Column:
        body = F.substring(x, 2, 1 << 30)
        return F.when(F.substring(x, 1, 1) == "d", F.replace(body, F.lit('""'), F.lit('"'))).otherwise(F.replace(body, F.lit("''"), F.lit("'")))

    def cut_plain(x: Column) -> Column:
        x = F.regexp_replace(x, rf"[{SIGNS}]", _CUT)
        x = F.regexp_replace(x, r"(?i)(?:(?<=\s)|^)(?:" + "|".join(WORDS) + r")(?=\s|$)", _CUT)
        return F.when(numbered, F.regexp_replace(x, _NUMBER, _CUT)).otherwise(x)

    # A literal is closed in by _QUOTE again, so that the values' clean-up below leaves it alone.
    rebuilt = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(_QUOTE), literal(x), F.lit(_QUOTE))).otherwise(cut_plain(x)))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        fresh = F.when(F.startswith(piece, F.lit(_QUOTE)), F.array(piece)).otherwise(F.split(piece, _CUT))
        joined = F.concat(state["open"], F.element_at(fresh, 1))
        many = F.size(fresh) > 1
        done = F.when(many, F.concat(state["done"], F.array(joined), F.slice(fresh, 2, F.greatest(F.size(fresh) - 2, F.lit(0))))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(many, F.element_at(fresh, -1)).otherwise(joined).alias("open"))

    values = F.aggregate(rebuilt, empty, step, lambda s: F.concat(s["done"], F.array(s["open"])))

    def clean(x: Column) -> Column:
        x = strip(x)
        x = F.regexp_replace(x, rf"^(?:[-*•·–]|\(?\d{{1,2}}[.)])\s+", "")
        return strip(F.replace(x, F.lit(_QUOTE), F.lit("")))

    values = F.filter(F.transform(values, clean), lambda x: F.length(x) > 0)
    if whole is not None:
        alone = strip(text)
        values = F.when(text.isNull(), F.lit(None)).when(whole, F.array(alone)).otherwise(values)
    return F.transform(values, lambda x, i: F.struct(i.cast("int").alias("pos"), x.alias("val")))


def split_rows(df: DataFrame, keys: Iterable[str], items: str, entries: DataFrame | None = None) -> DataFrame:
    """``keys``, item_no, raw, n, pos, val: one row per value of the array column ``items``.

    Elements that are one of ``entries`` (texts, in its first column) apart from case are not split; the entries are
    joined, and broadcast only if they are measured to be few. n is the number of values in the element.
    Null arrays and null or empty elements give no rows. Rows that agree in keys and items count once.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(items).alias("_items")).distinct().select(*keys, F.posexplode("_items").alias("item_no", "raw"))
    rows = rows.where(F.col("raw").isNotNull()).withColumn("_plain", strip(F.col("raw")))
    packed = F.coalesce(F.col("raw").rlike(rf"[{SIGNS}\"'(.)]|(?i)\s(?:{'|'.join(WORDS)})\s|{_MARK}"), F.lit(False))
    if entries is not None:
        known = entries.select(F.lower(strip(F.col(entries.columns[0]))).alias("_entry")).where("_entry is not null").distinct().withColumn("_whole", F.lit(True))
        rows = rows.join(small(known), F.lower("_plain") == F.col("_entry"), "left").drop("_entry")
        packed = packed & F.col("_whole").isNull()
    one = F.when(F.length("_plain") > 0, F.array(F.struct(F.lit(0).alias("pos"), F.col("_plain").alias("val")))).otherwise(F.array().cast("array<struct<pos:int,val:string>>"))
    rows = rows.withColumn("values", F.when(packed, split_packed(F.col("raw"))).otherwise(one))
    return rows.select(*keys, "item_no", "raw", F.size("values").alias("n"), F.explode("values").alias("v")).select(*keys, "item_no", "raw", "n", "v.pos", "v.val")


FIELDS = (("resumes", "candidate_id", "skills"), ("jds", "document_id", "mandatory_skills"), ("jds", "document_id", "preferred_technical_skills"))


def field_values(tables: dict[str, DataFrame], entries: DataFrame | None, fields=FIELDS) -> DataFrame:
    """field, record_id, item_no, raw, n, pos, val over the fields' tables."""
    out = None
    for name, key, items in fields:
        rows = split_rows(tables[name].withColumn("record_id", F.col(key)), ["record_id"], items, entries).withColumn("field", F.lit(f"{name}.{items}"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("field", "record_id", "item_no", "raw", "n", "pos", "val")


def found(tables: dict[str, DataFrame], entries: DataFrame | None) -> DataFrame:
    """field, record_id, item_no, pos, val: the values of every element that holds more than one.

    ``entries`` has the texts that are not split in its first column. Null lists, null, empty and blank elements and
    elements of delimiters only give no rows; long ones, quoted or not, are split whole. Values that repeat within an
    element are rows of their own, repeated rows of a table count once. Columns besides the keys and the lists are not
    read. Empty tables give an empty result.
    """
    return field_values(tables, entries).where("n > 1").select("field", "record_id", "item_no", "pos", "val").distinct()
