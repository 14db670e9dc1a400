import random

import pytest
from helpers import resume, resumes, rows

from sieveline.llm import canonical as C

SKILLS = [(1, "Python"), (2, "Java"), (3, "JavaScript"), (4, "C++"), (5, "C#"), (6, "R"), (7, "Apache Kafka"), (8, "Natural Language Processing"), (9, "Stream Processing"), (10, "Stakeholder Management"), (11, "A/B Testing"), (12, "Node.js"), (13, "SQL"), (14, "T-SQL"), (15, "Snowflake"), (16, "Apache Spark")]
TITLES = [(1, "Data Engineer"), (2, "Full Stack Developer"), (3, "Clinical Research Associate"), (4, "HR Business Partner")]


@pytest.mark.parametrize(
    "text, ref",
    [("pytohn", 1), ("PYTHON", 1), ("Python 3.11", 1), ("experience with Pyhton", 1), ("core java", 2), ("java script", 3), ("c++ expert", 4), ("kafka", 7), ("Kafka (Apache)", 7), ("NLP", 8), ("processing of streams", 9), ("stakeholder mgmt", 10),
     ("managing stakeholders", 10), ("a-b testing", 11), ("nodejs", 12), ("s.q.l.", 13), ("sql", 13), ("t sql", 14), ("snowflake paper craft", -1), ("Spark plug maintenance", -1), ("Java coffee roasting", -1), ("kayak building", -1), ("!!!", -1)],
)
def test_skills(text, ref):
    index = index_of(SKILLS, C.SKILLS)
    hit = index.best(text, C.SKILLS)
    assert (hit[0] if hit else -1) == ref


@pytest.mark.parametrize("text, ref", [("Senior Data Enginer", 1), ("Data Engineer - Talent Pool", 1), ("URGENT: data_engineer (m/f/d)", 1), ("Lead Full Satck Developer II, Care", 2), ("Sr. clinical research associate / People / Oxlode", 3), ("Lighthouse Keeper", -1), ("human resources business partner [Req 7]", 4),
    ("Hamburg - Data Engineer", 1), ("Remote | Data Enginer", 1), ("Senior, Data Engineer", 1), ("Lighthouse Keeper - Data Engineer", 1)])
def test_titles(text, ref):
    hit = index_of(TITLES, C.TITLES).best(text, C.TITLES)
    assert (hit[0] if hit else -1) == ref


@pytest.mark.parametrize("n", [8, 9, 12, 30])
def test_long_values_are_aligned_whatever_their_number_of_words(n):
    entry = [f"{a}{b}ording" for a in "bdfgklmnprst" for b in "aeiou"][:n]
    typed = [w[:2] + w[3] + w[2] + w[4:] for w in reversed(entry)]
    assert C.sureness(" ".join(typed), " ".join(entry)) > 0.85


def test_words_are_assigned_so_that_all_have_a_partner():
    assert C.sureness("manage management", "managing management") > 0.8  # both fit "management" best


def test_rules_for_sounds_and_lists():
    index = index_of([(1, "Python"), (2, "Grafana"), (3, "Hiring, Onboarding and Retention")], C.SKILLS)
    assert [index.best(t, C.SKILLS)[0] for t in ("graphana", "hiring to retention", "hirign to retention")] == [2, 3, 3]


def index_of(entries, rules):
    known = {}
    for n in (0, 1):
        for i, e in entries:
            for k, f in enumerate(C.forms(e, rules)):
                if (k > 0) == n:
                    known.setdefault(f, i)
    listed = sorted(known.items())
    held = sorted({p for f, _ in listed for p in C.pairs(f)})
    return C.Index(listed, {p: i for i, p in enumerate(held)})


def test_prefix_filter_loses_nothing():
    """The filtered search finds the same forms as comparing with all of them."""
    index = index_of(SKILLS, C.SKILLS)
    r = random.Random(4)
    for _ in range(1500):
        word = list(r.choice(SKILLS)[1].lower())
        for _ in range(r.randint(0, 5)):
            word[r.randrange(len(word))] = r.choice("abcdefg ")
        core = C.plain("".join(word))
        ps = set(C.pairs(core))
        want = set()
        for n, (f, _) in enumerate(index.listed):
            q = set(C.pairs(f))
            if ps | q and len(ps & q) / len(ps | q) >= C.JACCARD:
                want.add(n)
        assert {n for n, _ in index.near(core)} == want, core


def test_edits():
    assert [C.edits(a, b, 2) for a, b in (("abc", "acb"), ("abc", "abc"), ("abc", "xyz"), ("", "ab"), ("abcd", "abxcd"))] == [1, 0, 3, 2, 1]


def test_found(spark):
    people = resumes(spark, resume("r", skills=["Python", "pyhton, kayak", None, "", "x" * 200_000]), resume("n"), resume("e", skills=[]))
    jds = spark.createDataFrame([("d", "Data Enginer", ["SQL", "sql"], None), ("n", None, None, None), ("b", "  ", [], None)], "document_id string, role_title string, mandatory_skills array<string>, ref_id string")
    refs = {"skill_ref": spark.createDataFrame(SKILLS, "ref_id int, skill string"), "title_ref": spark.createDataFrame(TITLES, "ref_id int, title string")}
    got = rows(C.found({"resumes": people.union(people), "jds": jds, **refs}))
    assert got == sorted([("jds.mandatory_skills", "d", 1, 0, 13), ("jds.role_title", "d", 0, 0, 1), ("resumes.skills", "r", 1, 0, 1), ("resumes.skills", "r", 1, 1, -1), ("resumes.skills", "r", 4, 0, -1)], key=repr)
    assert C.found({"resumes": people.limit(0), "jds": jds.limit(0), **refs}).collect() == []
    none = C.found({"resumes": people, "jds": jds, "skill_ref": refs["skill_ref"].limit(0), "title_ref": refs["title_ref"].limit(0)})
    assert {r["ref_id"] for r in none.collect()} == {-1}


def test_blocks_of_the_list(spark, monkeypatch):
    values = spark.createDataFrame([("pytohn",), ("kafka",), ("zzz",), ("pytohn",), (None,)], "val string")
    skills = spark.createDataFrame([*SKILLS, (None, "Kafka"), (99, None), (98, " ")], "ref_id int, entry string")
    whole = rows(C.match(values, skills, C.SKILLS).select("val", "ref_id"))
    monkeypatch.setattr(C, "BLOCK", 7)
    assert rows(C.match(values, skills, C.SKILLS).select("val", "ref_id")) == [("kafka", 7), ("pytohn", 1), ("zzz", -1)]
