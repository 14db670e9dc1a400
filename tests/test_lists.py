import pytest
from helpers import F, job, one

from sieveline.functions import lists as L

STRINGS = "array<string>"


@pytest.mark.parametrize(
    "line, skills",
    [
        ("Strong SQL and good Python skills.", ["SQL", "Python"]),
        ("Hands-on experience with data validation, deduplication, consistency checks, and data quality control", ["data validation", "deduplication", "consistency checks", "data quality control"]),
        ("Experience building ETL or ELT pipelines in production.", ["ETL or ELT pipelines in production"]),
        ("document-heavy, workflow-heavy business data", ["document-heavy, workflow-heavy business data"]),
        ("Spark, dbt, Airflow, Dagster, Kafka, or similar tools", ["Spark", "dbt", "Airflow", "Dagster", "Kafka"]),
        ("collaborate closely with AI engineers, backend engineers, and product teams", []),
        ("5+ years of experience", []),
        ("SQL AND Python", ["SQL AND Python"]),
        ("", []),
        (None, []),
    ],
)
def test_atomize_line(spark, line, skills):
    assert one(spark, L.atomize_line(F.col("a")), a=(line, "string")) == skills


def test_keep_first(spark):
    assert one(spark, L.keep_first(F.col("a")), a=(["SQL", None, "sql ", "", "Go", "GO"], STRINGS)) == ["SQL", "Go"]
    assert one(spark, L.keep_first(F.col("a")), a=(None, STRINGS)) == []
    assert one(spark, L.atomize(F.col("a")), a=(["SQL and Go", "sql", None], STRINGS)) == ["SQL", "Go"]


def test_labelled_lines(spark):
    text = "Intro\nSkills: Python, SQL & and Go, work with many people\r\nTools used: sql, one two three four, Rust.\nHobby: chess"
    assert one(spark, L.labelled_tokens(F.col("a")), a=(text, "string")) == ["Python", "SQL", "Go", "Rust"]
    assert one(spark, L.recovered(F.col("a"), F.col("b")), a=(text, "string"), b=(["python"], STRINGS)) == ["SQL", "Go", "Rust"]
    assert one(spark, L.labelled_tokens(F.col("a")), a=(None, "string")) == []


def test_jobs(spark):
    kind = "array<struct<title:string,company:string,start_date_raw:string,end_date_raw:string,domain:string,description:string,technologies_used:array<string>>>"
    jobs = [job("2020", "2021", "A", "Dev", "x  y", ["Go"]), job("2020", "2021", "a", "dev", "X y", None), job("2020", "2022", "A", "Dev", "x y", ["SQL", "go"])]
    assert [j["end_date_raw"] for j in one(spark, L.dedupe_jobs(F.col("a")), a=(jobs, kind))] == ["2021", "2022"]
    everything = L.all_skills(F.array(F.lit("Rust")), F.col("a"), F.lit(None).cast("array<struct<technologies_used:array<string>>>"), F.array(F.lit("Cloud: AWS, Rust & in use"), F.lit("none")))
    assert one(spark, everything, a=(jobs, kind)) == ["Rust", "Go", "SQL", "AWS"]
    assert one(spark, L.titles(F.lit("Dev"), F.col("a")), a=(jobs, kind)) == ["Dev"]


def test_dropped_companies(spark):
    text = "Acme Works\nJan 2020 - Present\nOther Ltd\n2018 – 2019\nA B C D E F G H\n2018 - 2019"
    assert one(spark, L.dropped_companies(F.col("a"), F.col("b")), a=(text, "string"), b=(["ACME Works GmbH"], STRINGS)) == ["Other Ltd"]


def test_unused(spark):
    assert one(spark, L.unused_skills(F.col("a"), F.col("b")), a=(["SQL", "Go"], STRINGS), b=(["sql"], STRINGS)) == ["Go"]
