import random
from itertools import combinations, permutations

import pytest
from helpers import job, resume, resumes, rows

from sieveline.llm import names as N


@pytest.mark.parametrize(
    "a, b, same",
    [("Tim Velutmann", "Velutmann, Timothy", True), ("T. Velutmann - Flat 14, 45 Orchard Court, Pellimore", "Timothy Velutmann", True), ("Dr. Hana Dravugoto, MBA", "HANA DRAVUGOTO", True), ("IngridTavrulund\npassport no. X1", "Ingrid Tavrulund", True),
     ("Omar A. Fennusen", "Omar Fennusen", True), ("Vctoria Molviyan", "Victorea Molviyan", True), ("Søren Støruham", "Soren Storuham (CV 2024)", True), ("Andrew Olkuley", "Drew Olkuley", True), ("Anna Berg", "Olga Berg", False), ("Victoria Berg", "Vikram Berg", False),
     ("Leila Gromuvasan", "Leila Tavrulek", False), ("", "Leila Tavrulek", False), ("R. Gromuley-Folkunetti", "Rafael Gromuley-Folkunetti", True),
     ("Maria del Carmen de la Cruz Fernandez Ortega", "Ortega Fernandez, Maria del Carmen de la Cruz", True), ("Maria del Carmen de la Cruz Fernandez Ortega", "Maria del Carmen de la Cruz Gonzalez Puente", False),
     ("Beth Imbrugoto", "IMBRUGOTO, E.", True), ("Rick Storuham", "Rihard Storuham", True), ("Anthoy Storuham", "Anhony Storuham", True), ("Rick Storuham", "E. Storuham", False), ("Katie Ng", "Katherine Ng", True), ("Anna Velutmann", "Anna Valutmenn", True),
     ("MariadelCarmen Ortega", "Maria del Carmen Ortega", True), ("JoseLuisAlbertoCarlosPuente", "Jose Luis Alberto Carlos Puente", True), ("JoseLuisAlbertoCarlosPuente", "Jose Luis Alberto Carlos Pointes", False)],
)
def test_same_name(a, b, same):
    assert N.same_name(N.parse_person(a), N.parse_person(b)) is same


@pytest.mark.parametrize(
    "text, parsed",
    [("TBH - Tipzenpef Boblif Health", (["tipzenpef", "boblif"], "health", "")), ("Boblif Tipzenpef Healthcare Ltd.", (["tipzenpef", "boblif"], "health", "")), ("Kevkoknus Dodk. Consulting", (["kevkoknus"], "consulting", "dodk")), ("Vovrimkar Gapdam, Financial (S.A.)", (["vovrimkar", "gapdam"], "financial", "")), ("GmbH & Co", None)],
)
def test_parse_firm(text, parsed):
    assert N.parse_firm(text) == parsed


def test_deletions_find_every_single_edit():
    word = "karnonvem"
    for i in range(len(word)):
        for other in (word[:i] + word[i + 1 :], word[:i] + "x" + word[i:], word[:i] + "x" + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :]):
            assert N.deletions(word) & N.deletions(other), other


def test_names_of_any_number_of_parts_align_as_by_brute_force():
    r, pool = random.Random(3), ["ana", "anna", "maria", "marai", "a", "m", "bert", "robert", "rob", "cruz", "cruzz", "velutmann", "valutmenn"]
    for _ in range(3000):
        a, b = ([r.choice(pool) for _ in range(r.randint(1, 5))] for _ in "ab")
        if N.near_joined(a, b):
            continue
        x, y = (a, b) if len(a) <= len(b) else (b, a)
        best = None
        for chosen in permutations(range(len(y)), len(x)):
            each = [N.same_part(p, y[j]) for p, j in zip(x, chosen)]
            if all(each) and (best is None or sum(each) > best[0] + 1e-9):
                best = (sum(each), sum(s >= 0.85 for s in each))
        if best is None or not best[1] or len(x) == 1 < len(y):
            assert not N.same_name(a, b), (a, b)
        elif len(x) == len(y):
            assert N.same_name(a, b), (a, b)
    long = [f"part{n}{chr(97 + n % 26) * 3}" for n in range(60)]
    assert N.same_name(long, long[::-1]) and not N.same_name(long, ["other"] * 60)


def test_the_index_reaches_what_the_check_accepts():
    r = random.Random(4)
    for _ in range(400):
        word = "".join(r.choice("abcdefghi") for _ in range(r.randint(4, 11)))
        other = list(word)
        for _ in range(2 if len(word) >= N.TWO_EDITS else 1):
            k, kind = r.randrange(len(other)), r.randrange(4)
            other[k : k + 1] = [r.choice("xyz")] if kind == 0 else [] if kind == 1 else [other[k], "x"] if kind == 2 else [other[k]]
            if kind == 3 and k + 1 < len(other):
                other[k], other[k + 1] = other[k + 1], other[k]
        other = "".join(other)
        if min(len(word), len(other)) >= 4 and N.same_part(word, other) >= 0.85:
            assert N.part_keys(word) & N.part_keys(other), (word, other)


def test_group_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET", 3)
    df = spark.createDataFrame([("hot", f"m{n:02}") for n in range(20)] + [("x", "a"), ("y", "b"), ("y", "c")], "g string, m string")
    got = rows(N.group_pairs(df, "g", "m").select("a", "b"))
    assert got == sorted([*combinations([f"m{n:02}" for n in range(20)], 2), ("b", "c")], key=repr)


def edu(*schools):
    return [("BSc", field, school) for school, field in schools]


def test_found(spark):
    firms = ["Tipzenpef Boblif Health Ltd", "TBH - Tipzenpef Boblif Health", "Tipzenpef Bobilf Health", "Tipzenpefboblif Health", "Boblif Tipzenpef Healthcare", "Tipzenpef Bobl. Health", "Tipzenpef Boblif", "Karnonvem Mebfan Pharma", "Karnonvem Mebfan Foods AG", "Karnonvem Mebfan", "", None]
    df = resumes(
        spark,
        resume("p1", "Tim Velutmann", experience=[job(company=c) for c in firms], education=edu(("Menth College", "Law"))),
        resume("p2", "Velutmann, Timothy", experience=[job(company=firms[1])], education=edu(("menth college ", None))),
        resume("p3", "T. Velutmann", experience=[job(company=firms[0])], education=edu(("Menth College", "Law"))),
        resume("p4", "T. Velutmann", experience=[job(company=firms[0])], education=edu(("Menth College", "Law"))),
        resume("other school", "Tim Velutmann", experience=[job(company=firms[0])], education=edu(("Oxlode College", "Law"))),
        resume("other field", "Tim Velutmann", experience=[job(company="Solo Firm Media")], education=edu(("Menth College", "Law"))),
        resume("nameless", " ", experience=[job(company=firms[0])], education=edu(("Menth College", "Law"))),
        resume("null"),
        resume("long", "x" * 50_000, experience=[job(company="y" * 2_000)], education=edu(("z" * 50_000, "Law"))),
    )
    got = rows(N.found(df.union(df)))
    persons = [(a, b) for k, a, b in got if k == "person"]
    assert persons == sorted(combinations(["p1", "p2", "p3", "p4"], 2))
    classes = {r["candidate_id"]: (r["class_id"], r["n_links"]) for r in N.persons(df.union(df)).collect()}
    assert {c for c, (_, n) in classes.items() if n == 3} == {"p1", "p2", "p3", "p4"} and classes["p3"] == classes["p4"] and classes["p1"][0] != classes["p2"][0] and classes["other school"][1] == 0
    companies = {(a, b) for k, a, b in got if k == "company"}
    assert companies == {tuple(sorted(p)) for p in combinations(firms[:7], 2)}
    assert N.found(df.limit(0)).collect() == [] and N.persons(df.limit(0)).collect() == []


def test_firms_outside_the_lines_of_business_are_linked(spark):
    same = [["Acme Construction Ltd", "Acme Construction GmbH", "Acme Constructoin"], ["Siemens AG", "Siemens Ltd"], ["BMW AG", "BMW"], ["BMG Ltd"], ["Karnonvem Mebfan", "Karnonvem Mebfan Pharma"]]
    texts = spark.createDataFrame([(t, 1) for group in same for t in group], "text string, n long")
    firm = {r["text"]: r["firm"] for r in N.link_firms(texts).collect()}
    assert [len({firm[t] for t in group}) for group in same] == [1] * len(same) and len(set(firm.values())) == len(same)
    assert firm["Siemens AG"] == "siemens|"


def test_names_that_agree_in_full_by_the_given_name_alone_are_compared(spark):
    names = {"g1": "Anna Lee", "g2": "Anna L.", "g3": "Anna Le", "h1": "Katie Sto", "h2": "Katherine Storuham"}
    df = resumes(spark, *[resume(c, n, experience=[job(company="Solo Firm Media")], education=edu(("Menth College", "Law"))) for c, n in names.items()])
    pairs = {(a, b) for k, a, b in rows(N.found(df)) if k == "person"}
    assert pairs == {(a, b) for a, b in combinations(sorted(names), 2) if N.same_name(N.parse_person(names[a]), N.parse_person(names[b]))} and ("g1", "g2") in pairs and ("h1", "h2") in pairs
