import datetime as dt

import pytest
from helpers import job, resume, resumes, rows

from sieveline.operators import timestamps
from sieveline.session import scratch

CASES = [
    ("2018", "2018-01-01T00:00:00Z"), (" 2018 ", "2018-01-01T00:00:00Z"), ("Mar 24", "2024-03-01T00:00:00Z"), ("Sept. 2021", "2021-09-01T00:00:00Z"), ("Okt. 2021", "2021-10-01T00:00:00Z"), ("Feb/05", "2005-02-01T00:00:00Z"),
    ("Aug '19", "2019-08-01T00:00:00Z"), ("April, 2008", "2008-04-01T00:00:00Z"), ("10/2014", "2014-10-01T00:00:00Z"), ("03.2013", "2013-03-01T00:00:00Z"), ("2009/11", "2009-11-01T00:00:00Z"), ("20180207", "2018-02-07T00:00:00Z"),
    ("23.05.2024", "2024-05-23T00:00:00Z"), ("21-Dec-1999", "1999-12-21T00:00:00Z"), ("14. März 2022", "2022-03-14T00:00:00Z"), ("août 2003", "2003-08-01T00:00:00Z"), ("September 6, 2010", "2010-09-06T00:00:00Z"),
    ("2015-04-29 23:59:00", "2015-04-30T03:59:00Z"), ("2008-06-30T23:00:00+0530", "2008-06-30T17:30:00Z"), ("2013-10-27T00:30:00.250Z", "2013-10-27T00:30:00Z"), ("2020-03-29 02:30:00 Europe/Berlin", "2020-03-29T01:30:00Z"),
    ("2020-10-25 02:30:00 Europe/Berlin", "2020-10-25T00:30:00Z"), ("2023-05-08 23:45:00 America/New_York", "2023-05-09T03:45:00Z"), ("20.06.2021 23:45 CEST", "2021-06-20T21:45:00Z"), ("Jan 23, 2016 06:30 AM EST", "2016-01-23T11:30:00Z"),
    ("Oct 25, 2021 12:05 AM EDT", "2021-10-25T04:05:00Z"), ("1517965140", "2018-02-07T00:59:00Z"), ("1489882512417", "2017-03-19T00:15:12Z"), ("07 Feb 2018 09:00", "2018-02-07T14:00:00Z"),
]
NONE = ["", "   ", None, "Present", "till now", "see attached", "n/a", "-", "?", "2020-13-01", "31.02.2020", "2020-01-01 10:00:00 Foo/Bar", "99/99/2020", "Smarch 2020", "x" * 100_000]


def test_shapes(spark):
    jobs = [job(raw, None) for raw, _ in CASES] + [job(raw, raw) for raw in NONE]
    got = {r["item_no"]: r["utc"] for r in timestamps.found(resumes(spark, resume("a", experience=jobs, zone="America/New_York"))).collect()}
    assert got == {n: utc for n, (_, utc) in enumerate(CASES)}


def test_slash_order_is_one_per_resume(spark):
    df = resumes(
        spark, resume("day", experience=[job("03/04/2020", "13/01/2021")]), resume("month", experience=[job("03/04/2020", None), job("12/25/2003", None)]), resume("open", experience=[job("03/04/2020", None)]),
        resume("none"), resume("empty", experience=[]),
    )
    got = {(r[0], r[1], r[2]): r[3][:10] for r in timestamps.found(df).collect()}
    assert got[("day", 0, "start")] == "2020-04-03" and got[("month", 0, "start")] == "2020-03-04" and got[("open", 0, "start")] == "2020-04-03"
    assert got[("month", 1, "start")] == "2003-12-25" and len(got) == 5


def test_repeated_rows_and_no_rows(spark):
    df = resumes(spark, resume("a", experience=[job("2018", "2019")]))
    assert rows(timestamps.found(df.union(df))) == rows(timestamps.found(df))
    assert timestamps.found(df.limit(0)).collect() == []


def test_dictionary_grows_and_is_used_again(spark):
    path = scratch(spark, "book")
    first = spark.createDataFrame([("2018",), ("x",), (None,), ("2018",)], "raw string")
    assert timestamps.normalise(first, "raw", path=path).count() == 4
    assert spark.read.parquet(f"{path}/{timestamps.VERSION}").count() == 2
    second = spark.createDataFrame([("2018", "keep"), ("2019", "me")], "raw string, instant string")
    out = timestamps.normalise(second, "raw", path=path)
    assert spark.read.parquet(f"{path}/{timestamps.VERSION}").count() == 3
    assert [r["instant"] for r in out.orderBy("raw").collect()] == [dt.datetime(2018, 1, 1), dt.datetime(2019, 1, 1)]


def test_a_key_that_two_writers_added_counts_once(spark):
    path = scratch(spark, "book")
    df = spark.createDataFrame([("2018",), ("x",)], "raw string")
    timestamps.normalise(df, "raw", path=path).collect()
    once = spark.read.parquet(f"{path}/{timestamps.VERSION}")
    once.write.mode("append").parquet(f"{path}/{timestamps.VERSION}")
    assert timestamps.normalise(df, "raw", path=path).count() == 2


def test_session_zone_does_not_matter(spark):
    df = resumes(spark, resume("a", experience=[job("2018-02-03 10:00:00", "Mar 2019")], zone="Asia/Kolkata"))
    want = rows(timestamps.found(df))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(timestamps.found(df)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("word", ["Present", "till date", "PRESENT ", "ongoing."])
def test_open_words(spark, word):
    df = timestamps.normalise(spark.createDataFrame([(word,)], "raw string"), "raw")
    assert df.first()["is_open"] is True
