"""Abusive, hateful and sexual content: a factorization machine over hashed terms of sentences.

Ratings are of whole documents and name one kind, so training is of the multiple-instance sort: every sentence of a
document rated ``none`` is an example of none, a rated document has one sentence at least of its kind, and which one
that is gets decided again after every round. A document's score of a kind is that of its highest sentence.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut as checkpointed
from ..session import shared_dir, ship, spread

KINDS = ("abusive", "hateful", "sexual")
CLASSES = ("none", *KINDS)
#: Bounds of the training sample: rated documents, and sentences of them (both drawn by a hash, so the same at each run).
RATED_DOCUMENTS, SENTENCES = 16_000, 200_000
BITS, RANK = 17, 6
THRESHOLD = 0.3
#: Words of a window; longer sentences come in windows that overlap by half, so that unpunctuated texts are no problem.
LONGEST = 16

# Signs written in place of letters.
_SIGNS = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_TOKEN = re.compile(r"(?:[^\s,.;:?\"'()\[\]{}<>/\\#~`´“”‘’*_=-]|(?<=\w)\*+(?=\w))+")
_MIXED = re.compile(r"(?=.*[a-z])(?=.*[@4310$57|!+])")
_REPEAT = re.compile(r"([a-z])\1+")
_SPACED = re.compile(r"\b(?:[a-z][ .*_-]){2,}[a-z]\b")


@functools.lru_cache(300_000)
def _term(word: str) -> str:
    w = word.rstrip("!")
    if w.isdigit():
        return "0"
    if not w.isalpha() and _MIXED.match(w):
        w = w.translate(_SIGNS)
    return _REPEAT.sub(r"\1", w)


@functools.cache
def _unseen() -> dict[int, None]:
    """Accents and invisible signs, to be taken out of a text."""
    return {n: None for n in range(sys.maxunicode + 1) if unicodedata.combining(chr(n)) or unicodedata.category(chr(n)) == "Cf"}


def plain(text: str) -> str:
    """Lower case without accents and invisible signs."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).translate(_unseen()).lower()


def terms(sentence: str) -> list[str]:
    """Words of a plain sentence, with look-alike signs as letters, runs of a letter as one and numbers as 0."""
    t = sentence
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), t)
    return [w for w in map(_term, _TOKEN.findall(t)) if w]


def sentences(text: str) -> list[list[str]]:
    """The terms of every sentence; long ones come in overlapping windows."""
    parts = [p for p in (terms(s) for s in _SENTENCE.split(plain(text))) if p]
    out = []
    for p in parts:
        for a in range(0, max(1, len(p) - LONGEST // 2), LONGEST // 2):
            out.append(p[a : a + LONGEST])
    return out


class Features:
    """Hashed words and pairs of neighbours of many sentences, in rows of differing length."""

    def __init__(self, rows: list[list[str]], cache: dict[str, int] | None = None):
        cache = {} if cache is None else cache
        flat = []
        for row in rows:
            for w in row:
                n = cache.get(w)
                if n is None:
                    n = cache[w] = zlib.crc32(w.encode())
                flat.append(n)
        ids = np.array(flat, np.uint64)
        size = np.array([len(r) for r in rows], np.int64)
        ends = np.cumsum(size)
        line = np.repeat(np.arange(len(rows)), size)
        pair = (ids[:-1] * np.uint64(0x9E3779B1) + ids[1:] * np.uint64(0x85EBCA6B) + np.uint64(1)) if len(ids) else ids
        inside = line[:-1] == line[1:] if len(ids) else np.empty(0, bool)
        mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        all_ids = np.concatenate([mix(ids), mix(pair[inside])])
        all_lines = np.concatenate([line, line[:-1][inside]])
        order = np.argsort(all_lines, kind="stable")
        self.ids, self.size = all_ids[order], np.maximum(size, 0) + np.maximum(size - 1, 0)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.ends = ends

    def rows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of the picked rows."""
        n = self.size[pick]
        at = np.repeat(self.begin[pick] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        return self.ids[at], n


class Machine:
    """A factorization machine with a softmax over CLASSES."""

    def __init__(self, seed: int = 7):
        c, rng = len(CLASSES), np.random.default_rng(seed)
        self.bias = np.zeros(c, np.float32)
        self.weight = np.zeros((1 << BITS, c), np.float32)
        self.factor = rng.normal(0, 0.05, (1 << BITS, c * RANK)).astype(np.float32)

    def logits(self, ids: np.ndarray, size: np.ndarray):
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        c = len(CLASSES)
        f = self.factor[ids]
        total = np.add.reduceat(f, begin, axis=0)
        squares = np.add.reduceat(f * f, begin, axis=0)
        linear = np.add.reduceat(self.weight[ids], begin, axis=0)
        return self.bias + linear + 0.5 * (total * total - squares).reshape(-1, c, RANK).sum(2), f, total

    def probabilities(self, features: Features, step: int = 4096) -> np.ndarray:
        out = np.empty((len(features.size), len(CLASSES)), np.float32)
        for a in range(0, len(out), step):
            pick = np.arange(a, min(a + step, len(out)))
            z = self.logits(*features.rows(pick))[0]
            z = np.exp(z - z.max(1, keepdims=True))
            out[pick] = z / z.sum(1, keepdims=True)
        return out

    def train(self, features: Features, label: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.12, decay: float = 2e-4, seed: int = 3) -> None:
        """AdaGrad over shuffled batches; rows of weight 0 are passed over."""
        rng, c = np.random.default_rng(seed), len(CLASSES)
        seen_w, seen_f = np.full_like(self.weight, 0.1), np.full_like(self.factor, 0.1)
        rows = np.flatnonzero(weight > 0)
        for _ in range(epochs):
            rng.shuffle(rows)
            for a in range(0, len(rows), 256):
                pick = rows[a : a + 256]
                ids, size = features.rows(pick)
                z, f, total = self.logits(ids, size)
                z = np.exp(z - z.max(1, keepdims=True))
                g = z / z.sum(1, keepdims=True)
                g[np.arange(len(pick)), label[pick]] -= 1
                g *= weight[pick][:, None]
                line = np.repeat(np.arange(len(pick)), size)
                gw = g[line]
                gf = (np.repeat(g, RANK, axis=1)[line] * (total[line] - f)).astype(np.float32)
                order = np.argsort(ids, kind="stable")
                keys, first = np.unique(ids[order], return_index=True)
                gw = np.add.reduceat(gw[order], first, axis=0) + decay * self.weight[keys]
                gf = np.add.reduceat(gf[order], first, axis=0) + decay * self.factor[keys]
                seen_w[keys] += gw * gw
                seen_f[keys] += gf * gf
                self.weight[keys] -= rate * gw / np.sqrt(seen_w[keys])
                self.factor[keys] -= 0.4 * rate * gf / np.sqrt(seen_f[keys])
                self.bias -= 0.01 * rate * g.sum(0) / len(pick)


def first_guess(features: Features, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Evidence of each class for each sentence, from how many documents of a class hold its terms."""
    c = len(CLASSES)
    line_doc = np.repeat(doc, features.size)
    held = np.unique(line_doc * (1 << BITS) + features.ids)
    of_doc, term = held >> BITS, held & ((1 << BITS) - 1)
    doc_label = np.zeros(int(doc.max()) + 1, np.int64)
    doc_label[doc] = label
    df = np.bincount(doc_label[of_doc] * (1 << BITS) + term, minlength=c << BITS).reshape(c, -1)
    n = np.bincount(doc_label[np.unique(doc)], minlength=c)
    share = (df + 0.5) / (n[:, None] + 1.0)
    value = np.zeros((1 << BITS, c), np.float32)
    for k in range(1, c):
        rest = np.log(share[k] / share[0])
        others = [np.log(share[k] / share[j]) for j in range(1, c) if j != k and n[j]]
        margin = np.minimum.reduce([rest, *others]) if others else rest
        value[:, k] = np.sqrt(df[k]) * np.maximum(rest, 0) + 0.5 * np.sqrt(df[k]) * np.minimum(margin, rest)
    out = np.empty((len(features.size), c), np.float32)
    for x in range(0, len(out), 20_000):
        pick = np.arange(x, min(x + 20_000, len(out)))
        ids, size = features.rows(pick)
        each, begin = value[ids], np.concatenate([[0], np.cumsum(size)])[:-1]
        out[pick] = np.maximum.reduceat(each, begin, axis=0) + np.add.reduceat(each, begin, axis=0) / np.maximum(size, 3)[:, None]
    return out


def fit(rows: list[tuple[int, int, list[str]]], rounds: int = 3, seed: int = 7) -> Machine:
    """A machine from (document, class, terms) of the sentences of rated documents; without any it finds nothing.

    Which sentences are examples is decided by machines that did not see their documents: one for each half.
    """
    machine = Machine(seed)
    machine.bias[0] = 4.0
    rows = [r for r in rows if r[2]]
    if not rows:
        return machine
    features = Features([r[2] for r in rows])
    doc = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
    rated = np.array([r[1] for r in rows], np.int64)
    half = np.random.default_rng(seed).permutation(int(doc.max()) + 1)[doc] % 2
    score, least = first_guess(features, doc, rated), 0.0

    def trained(label: np.ndarray, weight: np.ndarray, epochs: int) -> Machine:
        m = Machine(seed)
        m.bias[0] = 1.0
        m.train(features, label, weight, epochs)
        return m

    for n in range(rounds + 1):
        label, weight = np.zeros(len(rows), np.int64), np.where(rated == 0, 1.0, 0.0).astype(np.float32)
        own = np.where(rated > 0, score[np.arange(len(rows)), rated], -np.inf)
        order = np.lexsort((own, doc))
        last = order[np.flatnonzero(np.append(np.diff(doc[order]) != 0, True))]
        last = last[(rated[last] > 0) & (own[last] > least)]  # a document without any such sentence is a rater's slip
        if n:
            sure = (score[:, 1:].max(1) > 0.7) & (rated > 0)
            label[sure], weight[sure] = score[sure, 1:].argmax(1) + 1, 1.0
            weight[(score[:, 0] < 0.2) & (rated == 0)] = 0.0  # so is a sentence of a kind in a document rated none
        label[last], weight[last] = rated[last], 1.0
        if n == rounds:
            return trained(label, weight, 5)
        score = np.empty((len(rows), len(CLASSES)), np.float32)
        for h in (0, 1):
            fitted = trained(label, np.where(half == h, weight, 0).astype(np.float32), 3)
            score[half != h] = fitted.probabilities(features)[half != h]
        least = 0.1 if n == 0 else 0.25
    return machine


def rated_documents(documents: DataFrame, labels: DataFrame, most: int = RATED_DOCUMENTS) -> DataFrame:
    """doc_id, text, rating of a bounded sample of rated documents, with the rating most raters gave."""
    votes = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "rating", "rater").where(F.col("rating").isin(*CLASSES)).distinct()
    votes = votes.groupBy("doc_id", "rating").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", F.col("rating") == "none", "rating")
    chosen = votes.groupBy("doc_id").agg(F.max_by("rating", rank).alias("rating"), F.max("n").alias("most"), F.sum("n").alias("all"))
    chosen = chosen.where("most * 2 > all").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most ``most`` rows of a number and one of four words
    return checkpointed(texts.join(F.broadcast(chosen.select("doc_id", "rating")), "doc_id").distinct())


def training_rows(rated: DataFrame, sentences_most: int = SENTENCES) -> list[tuple[int, int, list[str]]]:
    """(doc_id, class, terms) of the sentences of rated documents.

    Where the windows exceed the bound, half of it is for class none and half for the others, and what one half leaves
    goes to the other. In each half the first window of every document (by a hash) comes before any second one.
    """
    ship(rated.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, CLASSES.index(r), " ".join(s)) for d, r, t in zip(b["doc_id"], b["rating"], b["text"]) for s in sentences(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "class", "terms"])

    rows = spread(rated).mapInPandas(cut, "doc_id long, class int, terms string").distinct()
    mark = F.xxhash64("doc_id", "terms")
    rows = checkpointed(rows.withColumn("_turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(mark, "terms"))))
    counted = {r["none"]: r["n"] for r in rows.groupBy((F.col("class") == 0).alias("none")).agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = min(counted.get(False, 0), max(sentences_most // 2, sentences_most - counted.get(True, 0)))
    share = lambda cond, n: rows.where(cond).orderBy("_turn", mark, "doc_id", "terms").limit(n)
    rows = share("class != 0", kinds).unionByName(share("class = 0", sentences_most - kinds))
    return [(r["doc_id"], r["class"], [sys.intern(w) for w in r["terms"].split(" ")]) for r in rows.orderBy("doc_id", "terms").collect()]


def fitted(documents: DataFrame, labels: DataFrame, path: str | None = None) -> Machine:
    """The machine that the rated documents train, trained once: it is kept below ``path``, or in the shared folder.

    What it is kept under is a digest of the rated documents and of this module, so that neither other ratings nor other
    rules ever meet an old machine.
    """
    spark = documents.sparkSession
    rated = rated_documents(documents, labels)
    told = rated.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id", "rating", "text").cast("decimal(38,0)")).alias("sum")).first()
    digest = hashlib.md5(f"{told['n']} {told['sum']} {inspect.getsource(sys.modules[__name__])}".encode()).hexdigest()
    target = f"{(path or shared_dir(spark)).rstrip('/')}/sieveline-content-{digest}"
    machine = Machine.__new__(Machine)
    try:
        row = spark.read.parquet(target).first()
        machine.bias, machine.weight, machine.factor = (np.frombuffer(row[c], np.float32).reshape(shape) for c, shape in _SHAPES.items())
        return machine
    except Exception as error:  # no machine yet, or one that was not written to its end
        if not any(what in str(error) for what in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "NoneType")):
            raise
    machine = fit(training_rows(rated))
    parts = tuple(bytearray(x.astype(np.float32).tobytes()) for x in (machine.bias, machine.weight, machine.factor))
    spark.createDataFrame([parts], ", ".join(f"{c} binary" for c in _SHAPES)).coalesce(1).write.mode("overwrite").parquet(target)
    return machine


_SHAPES = {"bias": (len(CLASSES),), "weight": (1 << BITS, len(CLASSES)), "factor": (1 << BITS, len(CLASSES) * RANK)}


def score_documents(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, source, abusive, hateful, sexual: each document's scores (0 to 1).

    Null and empty texts score 0. Texts are scored whole, however long. Repeated rows come out as often as they occur.
    """
    ship(documents.sparkSession)
    kept = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.weight.astype(np.float16), machine.factor.astype(np.float16)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Machine.__new__(Machine)
        m.bias, m.weight, m.factor = (x.astype(np.float32) for x in kept.value)
        cache: dict[str, int] = {}
        for b in batches:
            best = np.zeros((len(b), len(CLASSES)), np.float32)
            rows, line = [], []

            def flush():
                if rows:
                    np.maximum.at(best, np.array(line), m.probabilities(Features(rows, cache)))
                    rows.clear()
                    line.clear()

            for n, text in enumerate(b["text"]):
                for s in sentences(text or ""):
                    rows.append(s)
                    line.append(n)
                    if len(rows) >= 20_000:
                        flush()
            flush()
            if len(cache) > 500_000:
                cache.clear()
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], **{k: best[:, i].astype(float) for i, k in enumerate(CLASSES) if i}})

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return spread(slim).mapInPandas(score, "doc_id long, source string, abusive double, hateful double, sexual double")


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(documents, fitted(documents, labels))


def long_form(scored: DataFrame) -> DataFrame:
    """doc_id, source, kind, score."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in KINDS])).alias("x")
    return scored.select("doc_id", "source", each).select("doc_id", "source", "x.*")


def found(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind of every document whose score of the kind reaches the threshold.

    Null and empty texts have no kind. Null and unknown ratings, and those that raters tie on, are not learnt from; without
    any rating nothing is found. Repeated rows count once, other columns are not read, empty tables give an empty result.
    """
    return long_form(scores(documents, labels)).where(F.col("score") >= threshold).select("doc_id", "kind").distinct()


def rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """source, kind, n_docs, n_found, rate; a null source is a source of its own."""
    rows = long_form(scores(documents, labels))
    out = rows.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("score") >= threshold).cast("long")).alias("n_found"))
    return out.withColumn("rate", F.col("n_found") / F.col("n_docs"))
