import pytest
from helpers import F, one, resume, resumes, rows

from sieveline.operators import packed

CASES = [
    ("Java, Demand Planning", ["Java", "Demand Planning"]), ("a; b | c/d • e · f & g", ["a", "b", "c", "d", "e", "f", "g"]), ("a\tb\nc", ["a", "b", "c"]), ("Redis, Go and SQL", ["Redis", "Go", "SQL"]), ("Redis or Go", ["Redis", "Go"]),
    ("Android, Orb", ["Android", "Orb"]), ("1) Ansible 2) AutoCAD 10) R", ["Ansible", "AutoCAD", "R"]), ("(1) a (2) b", ["a", "b"]), ("1. a 2. scala 2.13", ["a", "scala 2.13"]), ("- a\n- b - 3 yrs", ["a", "b - 3 yrs"]), ("* a\n\n* b", ["a", "b"]),
    ('"A/B Testing", SQL', ["A/B Testing", "SQL"]), ("'Budgeting, Forecasting and Reporting' / Go", ["Budgeting, Forecasting and Reporting", "Go"]), ('"12"" bird ringing", Go', ['12" bird ringing', "Go"]), ("docker's union steward, 'Go'", ["docker's union steward", "Go"]),
    ('8" tea tasting, Go', ['8" tea tasting', "Go"]), ("a, , b,", ["a", "b"]), (",;|", []), ("", []), ("'C++', 'GraphQL' or 'Salesforce'", ["C++", "GraphQL", "Salesforce"]), ('"a";"b"', ["a", "b"]), ("Hadoop (Apache), C#", ["Hadoop (Apache)", "C#"]),
    ("- \"a, b\"\n- c", ["a, b", "c"]), ("a, \"b", ["a", '"b']),
]


@pytest.mark.parametrize("text, values", CASES)
def test_split(spark, text, values):
    got = one(spark, packed.split_packed(F.col("a")), a=(text, "string"))
    assert [v["val"] for v in got] == values and [v["pos"] for v in got] == list(range(len(values)))


def test_null_and_whole(spark):
    assert one(spark, packed.split_packed(F.col("a")), a=(None, "string")) is None
    assert [v["val"] for v in one(spark, packed.split_packed(F.col("a"), F.lit(True)), a=(" a, b ", "string"))] == ["a, b"]


def test_found(spark):
    long = ", ".join(f"skill {n}" for n in range(5000))
    people = resumes(spark, resume("r", skills=["Java", None, "", "a, b", "ci/cd", "'a, b'", long]), resume("n"), resume("e", skills=[]))
    jds = spark.createDataFrame([("d", ["x; y"], None, "clash")], "document_id string, mandatory_skills array<string>, preferred_technical_skills array<string>, record_id string")
    got = rows(packed.found({"resumes": people.union(people), "jds": jds.union(jds)}, spark.createDataFrame([("CI/CD",), (None,), ("ci/cd ",)], "skill string")))
    short = [g for g in got if g[2] != 6 or g[0] != "resumes.skills"]
    assert short == sorted([("jds.mandatory_skills", "d", 0, 0, "x"), ("jds.mandatory_skills", "d", 0, 1, "y"), ("resumes.skills", "r", 3, 0, "a"), ("resumes.skills", "r", 3, 1, "b")], key=repr)
    assert len(got) == 5004
    assert packed.found({"resumes": people.limit(0), "jds": jds.limit(0)}, None).collect() == []


LONG = 100_000
LONG_CASES = {
    "quoted": (f'"{"x" * LONG}", Go', ["x" * LONG, "Go"]),
    "single": (f"'{'x, ' * (LONG // 3)}y', Go", ["x, " * (LONG // 3) + "y", "Go"]),
    "doubled": (f'"{chr(34) * 2 * (LONG // 2)}", Go', ['"' * (LONG // 2), "Go"]),
    "doubled in single": (f"'{chr(39) * 2 * (LONG // 2)}x', Go", ["'" * (LONG // 2) + "x", "Go"]),
    "unclosed": (f'Go, "{"x" * LONG}', ["Go", '"' + "x" * LONG]),
    "unclosed single": (f"Go, '{'it{0}s '.format(chr(39)) * (LONG // 5)}", ["Go", "'" + ("it's " * (LONG // 5)).strip()]),
    "plain": ("x" * LONG + ", Go", ["x" * LONG, "Go"]),
}


@pytest.mark.parametrize("name", sorted(LONG_CASES))
def test_long_elements_take_no_stack(spark, name):
    text, values = LONG_CASES[name]
    assert [v["val"] for v in one(spark, packed.split_packed(F.col("a")), a=(text, "string"))] == values


def by_hand(text):
    """The values of a text, read sign by sign."""
    import re

    numbered = re.match(r"\s*\(?1[.)]\s", text)
    stop = re.compile(r"[,;|/•·\n\r\t&]|(?<=\s)(?:and|or|und|oder|as well as)(?=\s|$)" + (r"|(?:^|(?<=\s))\(?\d{1,2}[.)]\s" if numbered else ""), re.I)
    out, at, start = [], 0, True
    value = ""
    while at <= len(text):
        if start:
            while at < len(text) and text[at] in " ":
                at += 1
            mark = re.compile(r"[-*•·–]\s+").match(text, at)
            if mark:
                at = mark.end()
            start = False
            if at < len(text) and text[at] in "\"'":
                q = text[at]
                end = at + 1
                while end < len(text):
                    if text[end] == q and text[end + 1 : end + 2] == q:
                        end += 2
                    elif text[end] == q and (q == '"' or not re.match(r"\w", text[end + 1 : end + 2] or " ")):
                        break
                    else:
                        end += 1
                after = text[end + 1 :]
                if end < len(text) and end > at and (not after.strip() or re.match(r"\s*[,;|/•·\n\r\t&]|\s+(?:and|or|und|oder)\s|\s+\(?\d{1,2}[.)]\s", after)):
                    value += text[at + 1 : end].replace(q + q, q)
                    at = end + 1
        hit = stop.match(text, at) if at < len(text) else None
        if at == len(text) or hit:
            out.append(value.strip())
            value, start = "", True
            at = hit.end() if hit else at + 1
        else:
            value += text[at]
            at += 1
    return [v for v in out if v]


@pytest.mark.parametrize("text, values", CASES)
def test_by_hand_agrees_on_the_cases(text, values):
    assert by_hand(text) == values


def test_all_values_against_reading_by_hand(spark, data):
    jds, people = spark.read.parquet(f"{data}/jds.parquet"), spark.read.parquet(f"{data}/resumes.parquet")
    lists = [people.select("skills"), jds.select("mandatory_skills"), jds.select("preferred_technical_skills")]
    raw = lists[0].union(lists[1]).union(lists[2]).select(F.explode("skills").alias("t")).where("t is not null").distinct()
    known = {r["skill"].lower() for r in spark.read.parquet(f"{data}/skill_ref.parquet").collect()}
    got = raw.select("t", F.transform(packed.split_packed(F.col("t")), lambda v: v["val"]).alias("v")).collect()
    assert len(got) > 100
    for r in got:
        if r["t"].strip().lower() not in known:
            assert r["v"] == by_hand(r["t"]), r["t"]
