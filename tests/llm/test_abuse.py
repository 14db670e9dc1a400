import random

import numpy as np
import pytest
from helpers import rows

from sieveline.llm import abuse as A

R = random.Random(3)
PLAIN = ["We met the team in the office on day {n}.", "The report covers {n} sites.", "You bring patience and care.", "Our policy forbids calling people an idiot.", "Kill the hanging process {n} and restart.", "Women in engineering network with {n} members.", "The breast clinic needs {n} nurses."]
BAD = {"abusive": ["You are such an {i}, get lost.", "Shut up, you {i}!"], "hateful": ["{g} are filthy and should be thrown out.", "No {g} please, they are disgusting."], "sexual": ["Send me nude pictures and touch me.", "I get horny when I see you."]}
INSULTS, GROUPS = ["idiot", "moron", "cretin", "bastard"], ["women", "foreigners", "old people", "believers"]


def document(kind):
    lines = [R.choice(PLAIN).format(n=R.randint(1, 99)) for _ in range(R.randint(3, 7))]
    if kind != "none":
        lines.insert(R.randrange(len(lines)), R.choice(BAD[kind]).format(i=R.choice(INSULTS), g=R.choice(GROUPS)))
    return " ".join(lines)


def corpus(n):
    return [(d, k, document(k)) for d in range(n) for k in [R.choice(["none", "none", "abusive", "hateful", "sexual"])]]


@pytest.fixture(scope="module")
def machine():
    docs = corpus(900)
    wrong = [(d, R.choice(A.CLASSES) if R.random() < 0.03 else k, t) for d, k, t in docs]
    return A.fit([(d, A.CLASSES.index(k), s) for d, k, t in wrong for s in A.sentences(t)])


def best(machine, text):
    rows = A.sentences(text)
    return machine.probabilities(A.Features(rows)).max(0) if rows else np.zeros(len(A.CLASSES))


def test_held_out_accuracy(machine):
    right = told = true = 0
    for _, k, t in corpus(500):
        p = best(machine, t)
        got = {c for i, c in enumerate(A.CLASSES) if i and p[i] >= A.THRESHOLD}
        right, told, true = right + (k in got), told + len(got), true + (k != "none")
    assert right / true > 0.95 and right / told > 0.95


@pytest.mark.parametrize("text, kind", [("YOU ARE SUCH AN IIIDIOT, GET LOST.", "abusive"), ("you are such an 1d1ot, get lost", "abusive"), ("i d i o t, you are such an idiot", "abusive"), ("Women are filthy and should be thrown out.", "hateful")])
def test_disguises(machine, text, kind):
    assert best(machine, "The report covers 3 sites.\n" + text)[A.CLASSES.index(kind)] >= A.THRESHOLD


def test_mentions_are_no_case(machine):
    for text in PLAIN:
        assert best(machine, text.format(n=5))[1:].max() < A.THRESHOLD, text


def test_interactions_beat_single_words():
    """Two words that are harmless alone: only their meeting is abusive."""
    rows = []
    for d in range(1200):
        a, b = R.random() < 0.5, R.random() < 0.5
        words = [R.choice("uvwxyz") * 3 for _ in range(6)] + ["alpha"] * a + ["fill"] + ["beta"] * b
        rows.append((d, int(a and b), words))
    f = A.Features([w for _, _, w in rows])
    label = np.array([k for _, k, _ in rows])
    m = A.Machine()
    m.train(f, label, np.ones(len(rows), np.float32), 20)
    assert (m.probabilities(f).argmax(1) == label).mean() > 0.97


def test_terms():
    assert A.terms(A.plain("Scumb@g!! sttttupid 2024 na\u00efve f*ck")) == ["scumbag", "stupid", "0", "naive", "f*ck"]
    assert A.terms("") == [] and A.sentences("") == []
    assert max(map(len, A.sentences("word " * 1000))) <= A.LONGEST


def test_tables(spark):
    base = corpus(300)
    docs = [(d, t, R.choice(["s", None])) for d, _, t in base] + [(1000, None, "s"), (1001, "", None), (1002, "word " * 100_000 + "You are such an idiot, get lost.", "s")]
    documents = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, source string, kind string, score string")
    votes = [(d, k, "r1") for d, k, _ in base] + [(1, "none", "r2"), (1, "abusive", "r3"), (2, None, "r1"), (None, "none", "r1"), (3, "odd", "r1")]
    labels = spark.createDataFrame(votes, "doc_id long, rating string, rater string")
    scored = A.scores(documents, labels).collect()
    assert len(scored) == len(docs) and all(0 <= r["abusive"] <= 1 for r in scored)
    found = rows(A.found(documents.union(documents), labels))
    assert (1002, "abusive") in found and not [f for f in found if f[0] in (1000, 1001)] and len(found) == len(set(found))
    rates = {(r["source"], r["kind"]): r for r in A.rates(documents, labels).collect()}
    assert sum(r["n_docs"] for k, r in rates.items() if k[1] == "abusive") == len(docs) and (None, "sexual") in rates
    assert A.found(documents, labels.limit(0)).collect() == [] and A.found(documents.limit(0), labels).collect() == []
    assert [(r[0], r[2]) for r in A.training_rows(A.rated_documents(documents, labels))] == [(r[0], r[2]) for r in A.training_rows(A.rated_documents(documents.repartition(5), labels))]


def test_no_class_and_no_document_fills_the_sample(spark):
    say = lambda n, m: "\n".join(f"Word{chr(97 + n)} line{chr(97 + i // 26)}x{chr(97 + i % 26)} here." for i in range(m))
    docs = [(0, "s", say(0, 300)), *[(n, "s", say(n, 30)) for n in range(1, 4)], *[(n, "s", say(n, 20)) for n in range(4, 9)]]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(n, "abusive" if n < 4 else "none", "r") for n in range(9)], "doc_id long, rating string, rater string")
    got = A.training_rows(A.rated_documents(documents, labels), sentences_most=80)
    assert len(got) == 80 and sum(c == 0 for _, c, _ in got) == 40
    assert {d: sum(x == d for x, _, _ in got) for d in range(9)} == {d: 10 if d < 4 else 8 for d in range(9)}
    got = A.training_rows(A.rated_documents(documents, labels), sentences_most=300)
    assert sum(c == 0 for _, c, _ in got) == 100 and len(got) == 300
    assert len(A.training_rows(A.rated_documents(documents, labels))) == 490


def test_a_machine_is_trained_once(spark, tmp_path, monkeypatch):
    base = corpus(120)
    documents = spark.createDataFrame([(d, t) for d, _, t in base], "doc_id long, text string")
    labels = spark.createDataFrame([(d, k, "r1") for d, k, _ in base], "doc_id long, rating string, rater string")
    first = A.fitted(documents, labels, str(tmp_path))
    trained = []
    monkeypatch.setattr(A, "fit", lambda rows: trained.append(len(rows)) or first)
    again = A.fitted(documents.repartition(3), labels, str(tmp_path))
    assert not trained and all((getattr(first, c) == getattr(again, c)).all() for c in ("bias", "weight", "factor"))
    A.fitted(documents, labels.where("doc_id != 1"), str(tmp_path))
    assert len(trained) == 1
