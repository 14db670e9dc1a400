import random

import pytest
from helpers import rows

from sieveline.llm import leakage as L

R = random.Random(12)
VOCABULARY = ["".join(R.choice("abcdefghijklmnoprstuvw") for _ in range(R.randint(2, 9))) for _ in range(400)]
ITEMS = [(n, " ".join(R.choice(VOCABULARY) for _ in range(R.randint(30, 70)))) for n in range(40)]
FILL = lambda n: " ".join(R.choice(VOCABULARY) for _ in range(n))


def quote(item, words, edits=0):
    w = item.split()
    a = R.randrange(len(w) - words + 1)
    out = w[a : a + words]
    for place in R.sample(range(2, len(out) - 2), edits):
        out[place] = R.choice(["", "otherwise", out[place] + " indeed"])
    return " ".join(x for x in out if x)


def search(docs, items=ITEMS):
    index = L.Index(items)
    out = set()
    for ids, texts in L._pieces([d for d, _ in docs], [t for _, t in docs], 2 * index.most):
        out |= {(d, i) for d, i, _, _, region, own, most in L.find(index, ids, texts) if region is None or most <= own}
    return out


def test_passages_and_short_quotes():
    docs, want = [], set()
    for n in range(300):
        item, text = R.choice(ITEMS)
        kind = n % 3
        if kind == 0:
            docs.append((n, f"{FILL(40)} {quote(text, R.randint(15, 30), 2)} {FILL(30)}"))
            want.add((n, item))
        elif kind == 1:
            docs.append((n, f"{FILL(40)} {quote(text, 7)} {FILL(30)}"))
        else:
            w = text.split()
            R.shuffle(w)
            docs.append((n, " ".join(w)))
    assert search(docs) == want


@pytest.mark.parametrize("change", [str.upper, lambda t: t.replace(" ", "  ,\n"), lambda t: "**" + t + "!**", lambda t: t[:33] + "-\n" + t[33:], lambda t: " ".join(x + "." for x in t.split())])
def test_form_does_not_matter(change):
    assert search([(1, FILL(20) + "\n" + change(quote(ITEMS[3][1], 20)) + " " + FILL(20))]) == {(1, 3)}


def test_alignment_against_brute_force():
    """The banded alignment agrees with a full one on what passes."""

    def full(a, b):
        h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                d = h[i - 1][j - 1] if h[i - 1][j - 1][0] > 0 else (0, -(i - 1))
                moves = [(d[0] + (L.MATCH if same else L.CHANGED), d[1]), (h[i - 1][j][0] + L.GAP, h[i - 1][j][1]), (h[i][j - 1][0] + L.GAP, h[i][j - 1][1])]
                h[i][j] = max(max(moves), (0, -(10**6)))
                length = i + h[i][j][1]
                if same and length >= L.WORDS and h[i][j][0] >= min(max(length, L.WORDS), L.LEAST_WORTH):
                    return True
        return False

    for n in range(120):
        item, text = R.choice(ITEMS)
        doc = (FILL(5) + " " + quote(text, R.randint(6, 28), R.choice((0, 1, 2))) + " " + FILL(5)).split()
        assert bool(search([(1, " ".join(doc))], [(item, text)])) == full(text.split(), doc), (n, doc)


@pytest.mark.parametrize("words, edits, least", [(w, e, 0.8 if w < 14 and e == 3 else 0.9) for w in (12, 13, 14, 16, 20) for e in range(4)])
def test_recall_of_short_edited_passages(words, edits, least):
    docs = []
    for n in range(150):
        item, text = R.choice(ITEMS)
        w = text.split()
        a = R.randrange(len(w) - words + 1)
        part = w[a : a + words]
        for place in R.sample(range(1, words - 1), edits):
            part[place] = R.choice(["", "otherwise", part[place] + " indeed"])
        docs.append((n, item, f"{FILL(30)} {' '.join(x for x in part if x)} {FILL(30)}"))
    got = search([(n, t) for n, _, t in docs])
    assert sum((n, i) in got for n, i, _ in docs) >= least * len(docs)


def test_the_lemma_counts_what_any_edits_leave():
    r = random.Random(8)
    for _ in range(200):
        sizes = [r.randint(1, 11) for _ in range(L.WORDS)]
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)) for k in sizes]
        grams = lambda ws: {"".join(ws)[i : i + L.Q] for i in range(len("".join(ws)) - L.Q + 1)}
        least = L.least_hits(L.np.array([len(w) for w in words]))[0]
        edited = r.sample(range(1, L.WORDS - 1), L.EDITS)
        kept = grams(words) & grams([("#" * r.randint(1, 12) if n in edited else w) for n, w in enumerate(words)])
        assert least == 1 or len(kept) >= least


def test_another_items_text_is_no_passage(spark, monkeypatch):
    first = "in case {} one senior {} asserts {} weeks of {} for {} and the panel from {} confirms it in writing before the vote"
    items = [(n, first.format(*(VOCABULARY[(n * 7 + k) % 400] for k in range(6)))) for n in range(12)]
    docs = [(n, f"{FILL(20)} {t} {FILL(20)}") for n, t in items]
    assert search(docs, items) == {(n, n) for n, _ in items}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [(n, n) for n in range(12)]
    assert rows(L.found(*frames)) == sorted(want, key=repr)
    monkeypatch.setattr(L, "BLOCK", 150)
    assert rows(L.found(*frames)) == sorted(want, key=repr)


def test_chunks_do_not_matter(monkeypatch):
    docs = [(n, f"{FILL(R.randint(0, 60))} {quote(R.choice(ITEMS)[1], R.randint(10, 20), R.randint(0, 2))} {FILL(40)}") for n in range(200)]
    whole = search(docs)
    for size in (1, 2_000, 10_000):
        monkeypatch.setattr(L, "CHUNK", size if size > 1 else 700)
        assert search(docs) == whole


def test_very_long_text():
    far = FILL(60_000)
    assert search([(1, far + " " + quote(ITEMS[5][1], 25) + " " + far)]) == {(1, 5)}


def test_leaks(spark, monkeypatch):
    docs = [(1, FILL(9) + " " + quote(ITEMS[0][1], 18)), (2, None), (3, ""), (4, "!!!"), (1, "again " + ITEMS[0][1]), (None, ITEMS[1][1]), (5, ITEMS[2][1] + " " + ITEMS[7][1])]
    documents = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, item_id string, worth string")
    items = spark.createDataFrame([*ITEMS, (0, ITEMS[0][1]), (900, ITEMS[2][1]), (901, "too short"), (902, None), (903, "")], "item_id long, text string")
    want = [(1, 0), (5, 2), (5, 7), (5, 900)]
    assert rows(L.found(documents, items)) == want
    monkeypatch.setattr(L, "BLOCK", 1000)
    assert rows(L.found(documents, items)) == want
    assert L.found(documents.limit(0), items).collect() == [] and L.found(documents, items.limit(0)).collect() == []
    report = L.item_report(documents, items)
    assert rows(report) == [(0, 1), (2, 1), (7, 1), (900, 1)]
