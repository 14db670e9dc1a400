import pytest
from helpers import job, resume, resumes, rows

from sieveline.llm import pii
from sieveline.llm.pii_table import labelled

TEXT = "Questions to Mr Nagriposch (anna.berg+cv@mailnest.test). Reach me on +49 30 23125168 or 0049 (0)30 / 23125-152.\nHome address 130 Quarry Road, Oxlode QZ6 9XX. Closed ticket INC-9115-90 and order 4500-792-9115. Signed the lease with Berg & Lund AG for 4 desks. Work permit issued, SSN 000-99-2674."


@pytest.fixture(scope="module")
def field():
    return pii.trained()


def test_mentions(field):
    got = [(k, TEXT[a:b]) for k, a, b in pii.mentions(field, [TEXT])[0]]
    assert [k for k, _ in got] == ["person", "email", "phone", "phone", "address", "id_number"]
    assert got[1][1] == "anna.berg+cv@mailnest.test" and got[3][1] == "0049 (0)30 / 23125-152" and got[4][1] == "130 Quarry Road, Oxlode QZ6 9XX"


def agreement(field, part=None):
    """Mentions exactly as marked in another draw of the table: share found, share right."""
    hit = told = true = 0
    for pieces in labelled(600, seed=99, part=part):
        text, want = "", set()
        for t, kind in pieces:
            if kind:
                ts = pii.tokens(t)
                want.add((kind, len(text) + ts[0][1], len(text) + ts[-1][2]))
            text += t
        got = set(pii.mentions(field, [text])[0])
        hit, told, true = hit + len(got & want), told + len(got), true + len(want)
    return hit / true, hit / told


def test_held_out_values(field):
    """The lines of the table with other values in their slots."""
    assert min(agreement(field)) > 0.97


@pytest.mark.parametrize("part, least", [(0, 0.9), (1, 0.82)])
def test_held_out_lines(part, least):
    """Learnt from half of the lines, scored on the other half: what writing that was not seen may expect."""
    assert min(agreement(pii.trained(3_000, part=part), 1 - part)) > least


def test_many_mentions_in_a_text(spark):
    text = "Contact: anna.berg@mailnest.test\n" * 3_000
    got = pii.found(resumes(spark, resume("a", "Ann", experience=[job(description=text)]))).where("kind = 'email'")
    assert sorted(r["nth"] for r in got.collect()) == list(range(1, 3_001))


def test_decoding_against_brute_force(field):
    """Viterbi in batches gives the labels of the best of all paths."""
    from itertools import product

    import numpy as np

    chains = [["Call", "+", "1"], ["Ann"], ["a", "@", "b", "."], []]
    batch = pii.Batch(chains)
    scores, best, at = field.emissions(batch), field.decode(batch), 0
    for words in chains:
        n = len(words)
        if n:
            part = scores[at : at + n]
            paths = [p for p in product(range(len(pii.LABELS)), repeat=n) if not pii.LABELS[p[0]].startswith("I-")]
            worth = [sum(part[i, x] for i, x in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:])) for p in paths]
            assert np.isclose(max(worth), worth[paths.index(tuple(best[at : at + n].tolist()))], atol=1e-3)
        at += n


def test_redaction_keeps_the_rest(field):
    hits = pii.mentions(field, [TEXT])[0]
    out = pii.redact(TEXT, hits)
    assert "[EMAIL]" in out and "INC-9115-90" in out and "anna.berg" not in out and out.endswith("issued, [ID_NUMBER].") and pii.redact("as is", []) == "as is"


def test_long_text(field):
    text = ("Trained 14 people in Java so that shift leads trusted the rota. " * 400 + "Contact: anna.berg@mailnest.test. ") * 5
    got = pii.mentions(field, [text])[0]
    assert [k for k, _, _ in got] == ["email"] * 5 and all(text[a:b] == "anna.berg@mailnest.test" for _, a, b in got)


def test_found(spark):
    df = resumes(
        spark, resume("a", "Ann Berg (312-555-0152)", experience=[job(description=None), job(description="Contact: a@mailnest.test\nContact: b@mailnest.test"), job(description="")], projects=[("P", "Reference: Ann Berg, 617-555-0118.", None)]),
        resume("n"), resume("e", "", experience=[], projects=[]),
    )
    got = rows(pii.found(df.union(df)))
    assert got == sorted([("a", "candidate_name", 0, "phone", 1), ("a", "experience.description", 1, "email", 1), ("a", "experience.description", 1, "email", 2), ("a", "projects.description", 0, "person", 1), ("a", "projects.description", 0, "phone", 1)], key=repr)
    assert ("a", "candidate_name", 0, "Ann Berg ([PHONE])") in rows(pii.redacted(df))
    assert pii.found(df.limit(0)).collect() == []
