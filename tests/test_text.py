import difflib
import random

import pytest
from helpers import F, one
from pyspark.sql import Row

from sieveline.functions import text as T


@pytest.mark.parametrize("text, slug", [("AI/ML Engineer II", "ai-ml-engineer-ii"), ("", "unknown-role"), (None, "unknown-role"), (" -- ", "unknown-role"), ("\tData  Analyst\n", "data-analyst")])
def test_slug(spark, text, slug):
    assert one(spark, T.slugify(F.col("a")), a=(text, "string")) == slug


@pytest.mark.parametrize("text, needle, found", [("javascript", "java", False), ("aws lambda", "aws", True), ("c++", "c", True), ("i use .net", ".net", True), ("abc", "", False), ("a\\e b", "\\e", False), (None, "a", False)])
def test_words_at_bounds(spark, text, needle, found):
    assert one(spark, T.contains_word(F.col("a"), F.col("b")), a=(text, "string"), b=(needle, "string")) is found


@pytest.mark.parametrize("item, text, found", [("Data Modelling", "modelling of data", True), ("Data Modelling", "data only", False), ("", "x", False), (None, "x", False), ("“SQL”", 'the "sql" test', True)])
def test_support(spark, item, text, found):
    assert one(spark, T.supports(F.col("a"), T.guard_norm(F.col("b"))), a=(item, "string"), b=(text, "string")) is found


def test_sets_and_vectors(spark):
    sets = {"a": (["x", "y"], "array<string>"), "b": (["y", "z"], "array<string>"), "c": ([], "array<string>")}
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), **sets) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(F.col("a"), F.col("c")), **sets) == 0
    v = {"a": ([1.0, 0.0, 5.0], "array<float>"), "b": ([1.0, 1.0], "array<float>"), "c": ([0.0, 0.0], "array<float>")}
    assert one(spark, T.cosine(F.col("a"), F.col("b")), **v) == pytest.approx(1 / (26**0.5 * 2**0.5))
    assert one(spark, T.cosine(F.col("a"), F.col("c")), **v) == 0


@pytest.mark.parametrize("text, tier", [("PhD", "phd"), ("Bachelor of Arts", "bachelor"), ("B.Tech", "bachelor"), ("MSc", "master"), ("Diploma in Mechanical", "master"), ("Diploma", "diploma"), (None, "other"), ("Certificate 4", "other")])
def test_degree_tier(spark, text, tier):
    assert one(spark, T.degree_tier(F.col("a")), a=(text, "string")) == tier


@pytest.mark.parametrize("field, found", [(None, True), ("any", True), ("Physics or Statistics", True), ("Law", False), ("Science Computer", True)])
def test_field_overlap(spark, field, found):
    edu = ([Row(degree_level="BSc", field="Computer Science", institution=None), Row(degree_level=None, field="Statistics", institution=None)], "array<struct<degree_level:string,field:string,institution:string>>")
    assert one(spark, T.field_overlap(F.col("a"), F.col("e")), a=(field, "string"), e=edu) is found
    assert one(spark, T.field_overlap(F.lit("Law"), F.col("e")), e=(None, edu[1])) is False


def test_citations(spark):
    t = lambda r, e, j: one(spark, T.false_citation(F.col("r"), F.col("e"), F.col("j")), r=(r, "string"), e=(e, "string"), j=(j, "string"))
    assert t("the evidence states 'Data Engineer'", "Manager", "Data Engineer — AI Data Platform") == "Data Engineer"
    assert t("close to Data Engineer roles", "Manager", "Data Engineer") == "Data Engineer"
    assert t("states 'Data Engineer'", "Senior Data Engineer", "Data Engineer") is None
    assert t(None, None, None) is None


def test_ratio(spark):
    df = spark.createDataFrame([("tide", "diet"), ("", None), ("data engineer", "data engineer")], "a string, b string")
    assert [r["r"] for r in df.select(T.sequence_ratio("a", "b").alias("r")).collect()] == [difflib.SequenceMatcher(None, "tide", "diet").ratio(), 1.0, 1.0]


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_rounding_is_that_of_the_exact_value(spark, digits):
    r = random.Random(digits)
    values = [2.675, 0.5, 1.5, 2.5, 0.125, 0.375, -2.675, -0.5, 0.0, 1.005, 1.115, 72.985, 1e-9, 123456.785]
    values += [n / 10 ** (digits + 1) for n in range(5, 4000, 10)] + [r.uniform(0, 100) for _ in range(500)] + [r.randint(0, 10**6) * 0.05 * r.random() for _ in range(500)]
    values += [sum(r.choice((25, 17.5, 8.75, 6.43, 3.571, 1.2345)) for _ in range(r.randint(1, 6))) / r.randint(1, 7) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", T.round_half_even(F.col("x"), digits).alias("q")).collect()
    assert [(r["x"], r["q"]) for r in got if r["q"] != round(r["x"], digits)] == []
    assert one(spark, T.round_half_even(F.col("x"), digits), x=(None, "double")) is None


def test_display(spark):
    assert [one(spark, T.initials(F.col("a")), a=(n, "string")) for n in ("ada  lovelace king", "", None)] == ["AL", "?", "?"]
    edu = "array<struct<degree_level:string,field:string,institution:string>>"
    assert one(spark, T.format_education(F.col("e")), e=([Row("BSc", "Law", None), Row("MSc", None, None)], edu)) == "BSc — Law, MSc"
    assert one(spark, T.format_education(F.col("e")), e=(None, edu)) == "—"
