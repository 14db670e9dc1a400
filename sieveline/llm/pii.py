"""Private details in free text: a linear-chain conditional random field over word shapes, decoded in numpy batches.

Features of a word come from a table of the batch's distinct words, one column block for each place beside the decoded
word, so that scoring a token is a few look-ups. Decoding runs over all texts of like length at once.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread
from .names import _GIVEN
from .pii_table import KINDS, labelled

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BITS = 18
#: Tokens decoded as one chain; longer texts are cut into chains that overlap by MARGIN tokens on either side.
CHAIN, MARGIN = 400, 40
PLACES = (-3, -2, -1, 0, 1, 2, 3)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n+|[^\w\s]|_")
_PAD = "\0"


def words(text: str) -> list[str]:
    """The tokens without their places, for texts that may hold no mention at all."""
    found = _TOKEN.findall(text)
    return ["\n" if w[0] == "\n" else w for w in found] if "\n\n" in text else found


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0] if m[0][0] != "\n" else "\n", m.start(), m.end()) for m in _TOKEN.finditer(text)]


@functools.lru_cache(200_000)
def _word_features(w: str) -> tuple[int, ...]:
    """Hashes of a word: itself, its shape, its short shape, its beginning, its end, and what list it is on."""
    low = w.lower()
    shape = re.sub(r"\d", "9", re.sub(r"[a-zà-öø-ÿß-ɏ]", "x", re.sub(r"[A-ZÀ-ÖØ-Þ]", "X", w)))
    if len(shape) > 6 and shape[0] != "9":
        shape = shape[:2] + "+" + shape[-1]
    if low.isdigit():
        low = "9" * len(low)
    short = re.sub(r"(.)\1+", r"\1", shape)
    parts = (f"w{low}", f"s{shape}", f"c{short}", f"p{low[:3]}", f"e{low[-3:]}", f"g{low in _GIVEN}{len(w) == 1}{w[:1].isupper()}")
    return tuple(zlib.crc32(p.encode()) for p in parts)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


class Batch:
    """Chains of words as indices into their distinct words; index 0 is the place before and after a chain."""

    def __init__(self, chains: list[list[str]]):
        seen: dict[str, int] = {_PAD: 0}
        flat, lengths = [], []
        for words in chains:
            flat += [0, 0, 0]
            flat += [seen.setdefault(w, len(seen)) for w in words]
            flat += [0, 0, 0]
            lengths.append(len(words))
        self.lengths = np.array(lengths, np.int64)
        self.index = np.array(flat, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 6)])[:-1] + 3
        self.words = np.array([_word_features(w) for w in seen], np.uint64)
        inside = np.ones(len(self.index), bool)
        for k in (-3, -2, -1):
            inside[self.starts + k] = False
        for k in (0, 1, 2):
            inside[self.starts + self.lengths + k] = False
        self.inside = np.flatnonzero(inside)  # places of the real words, in order

    def place_ids(self, place: int) -> np.ndarray:
        """Feature numbers of every distinct word seen from ``place`` words before or after."""
        columns = self.words if abs(place) < 3 else self.words[:, :2]
        return _mix(columns * np.uint64(16) + np.uint64(place + 4))

    def joint_ids(self) -> np.ndarray:
        """Feature numbers that join neighbours, for every real word."""
        at = self.inside
        low = [self.words[self.index[at + k], 0] for k in (-2, -1, 0, 1, 2)]
        shape = [self.words[self.index[at + k], 2] for k in (-2, -1, 0, 1, 2)]
        long = [self.words[self.index[at + k], 1] for k in (-2, -1, 0, 1, 2)]
        p = [np.uint64(x) for x in (1000003, 998244353, 1000000007, 777767777, 444444443)]
        joined = [
            low[1] * p[0] + long[2] + np.uint64(11), long[1] * p[1] + long[2] * p[2] + long[3] + np.uint64(12), low[0] * p[2] + low[1] * p[3] + shape[2] + np.uint64(13),
            long[2] * p[3] + low[3] * p[0] + np.uint64(14), shape[0] * p[0] + shape[1] * p[1] + shape[2] * p[2] + shape[3] * p[3] + shape[4] * p[4] + np.uint64(15),
            long[2] * p[4] + low[3] * p[1] + long[4] + np.uint64(16), low[0] * p[1] + shape[1] * p[4] + long[2] + np.uint64(17),
        ]
        return np.stack([_mix(x) for x in joined], 1)


class Field:
    """Weights of the features and of the label pairs."""

    def __init__(self):
        n = len(LABELS)
        self.weight = np.zeros((1 << BITS, n), np.float32)
        self.step = np.zeros((n, n), np.float32)
        for j, b in enumerate(LABELS):
            if b.startswith("I-"):
                for i, a in enumerate(LABELS):
                    if a[2:] != b[2:]:
                        self.step[i, j] = -1e4
        self.fixed = self.step < -1e3

    def emissions(self, batch: Batch) -> np.ndarray:
        """Scores of the labels of every real word."""
        out = np.zeros((len(batch.inside), len(LABELS)), np.float32)
        for place in PLACES:
            table = self.weight[batch.place_ids(place)].sum(1)
            out += table[batch.index[batch.inside + place]]
        joint = batch.joint_ids()
        for k in range(joint.shape[1]):
            out += self.weight[joint[:, k]]
        return out

    def decode(self, batch: Batch) -> np.ndarray:
        """The best labels of every real word, by Viterbi over chains of like length together."""
        scores = self.emissions(batch)
        begin = np.concatenate([[0], np.cumsum(batch.lengths)])[:-1]
        out = np.zeros(len(scores), np.int64)
        order = np.argsort(batch.lengths, kind="stable")
        order = order[batch.lengths[order] > 0]
        for a in range(0, len(order), 512):
            part = order[a : a + 512]
            size, base = batch.lengths[part], begin[part]
            most = int(size.max())
            back = np.zeros((most, len(part), len(LABELS)), np.int8)
            state = scores[base] + np.where(np.char.startswith(LABELS, "I-"), np.float32(-1e4), np.float32(0))
            for t in range(1, most):
                live = t < size
                through = state[:, :, None] + self.step
                back[t] = through.argmax(1)
                fresh = through.max(1) + scores[np.minimum(base + t, len(scores) - 1)]
                state = np.where(live[:, None], fresh, state)
            label = state.argmax(1)
            for t in range(most - 1, -1, -1):
                live = t < size
                out[(base + t)[live]] = label[live]
                if t:
                    label = np.where(live, back[t][np.arange(len(part)), label], label)
        return out

    def train(self, chains: list[list[str]], labels: list[np.ndarray], epochs: int = 4, rate: float = 0.15, decay: float = 1e-5, seed: int = 5) -> None:
        """AdaGrad on the log-likelihood, with expectations by forward and backward passes over padded batches."""
        rng, n = np.random.default_rng(seed), len(LABELS)
        seen, seen_step = np.full_like(self.weight, 0.05), np.full_like(self.step, 0.05)
        order = np.argsort([len(c) for c in chains], kind="stable")
        groups = [order[a : a + 48] for a in range(0, len(order), 48)]
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                part = [i for i in groups[g] if len(chains[i])]
                if not part:
                    continue
                batch = Batch([chains[i] for i in part])
                gold = np.concatenate([labels[i] for i in part])
                scores = self.emissions(batch)
                node, pair = self._expected(scores, batch.lengths)
                node[np.arange(len(gold)), gold] -= 1
                first = np.concatenate([[0], np.cumsum(batch.lengths)])[:-1]
                follows = np.ones(len(gold), bool)
                follows[first] = False
                at = np.flatnonzero(follows)
                np.subtract.at(pair, (gold[at - 1], gold[at]), 1)
                pair[self.fixed] = 0
                ids = [batch.place_ids(p)[batch.index[batch.inside + p]] for p in PLACES] + [batch.joint_ids()]
                width = [x.shape[1] for x in ids]
                flat = np.concatenate([x.ravel() for x in ids])
                token = np.concatenate([np.repeat(np.arange(len(gold)), w) for w in width])
                by = np.argsort(flat, kind="stable")
                keys, begin = np.unique(flat[by], return_index=True)
                grad = np.add.reduceat(node[token[by]], begin, axis=0) + decay * self.weight[keys]
                seen[keys] += grad * grad
                self.weight[keys] -= rate * grad / np.sqrt(seen[keys])
                seen_step += pair * pair
                self.step -= rate * pair / np.sqrt(seen_step)

    def _expected(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels of every word and expected label pairs."""
        n, size, most = len(LABELS), len(lengths), int(lengths.max())
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        at = np.minimum(begin[:, None] + np.arange(most), len(scores) - 1)
        s = scores[at]
        live = np.arange(most) < lengths[:, None]
        start = np.where(np.char.startswith(LABELS, "I-"), -1e4, 0.0)
        step = np.exp(self.step.astype(np.float64))
        top = s.max(2, keepdims=True)
        e = np.exp((s - top).astype(np.float64))
        alpha = np.zeros((most, size, n))
        alpha[0] = e[:, 0] * np.exp(start)
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, most):
            a = (alpha[t - 1] @ step) * e[:, t]
            alpha[t] = a / a.sum(1, keepdims=True)
        beta = np.ones((most, size, n))
        for t in range(most - 2, -1, -1):
            b = (beta[t + 1] * e[:, t + 1]) @ step.T
            b /= b.sum(1, keepdims=True)
            beta[t] = np.where(live[:, t + 1][:, None], b, 1.0)
        node = alpha * beta
        node /= node.sum(2, keepdims=True)
        pair = np.zeros((n, n))
        for t in range(1, most):
            x = alpha[t - 1][:, :, None] * step * (e[:, t] * beta[t])[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            pair += x[live[:, t]].sum(0)
        return node.transpose(1, 0, 2)[live].astype(np.float32), pair.astype(np.float32)


#: Share of the words around mentions that are made strange in every second text learnt from.
STRANGE = 0.3


def strange(word: str, rng: random.Random) -> str:
    """A word of the same shape that no one has seen, so that what stands around a mention is not learnt by heart."""
    letters = "".join(rng.choice("aeiou" if n % 2 else "bcdfghklmnprstvw") for n in range(max(len(word), 2) if len(word) > 3 else rng.randint(2, 4)))
    return letters.upper() if word.isupper() and len(word) > 1 else letters.capitalize() if word[0].isupper() else letters


@functools.lru_cache(4)
def trained(texts: int = 6_000, seed: int = 11, part: int | None = None) -> Field:
    """A field trained from the labelled table, or from half of its lines; the same for the same arguments."""
    chains, labels = [], []
    rng = random.Random(seed)
    for row, pieces in enumerate(labelled(texts, seed, part)):
        words, own = [], []
        for text, kind in pieces:
            for n, (w, _, _) in enumerate(tokens(text)):
                if not kind and row % 2 and w.isalpha() and rng.random() < STRANGE:
                    w = strange(w, rng)
                words.append(w)
                own.append(LABELS.index(f"{'I' if n else 'B'}-{kind}") if kind else 0)
        chains.append(words)
        labels.append(np.array(own, np.int64))
    field = Field()
    field.train(chains, labels)
    return field


# What a mention of a kind must hold at least, for the check after decoding; an address may be without a number.
_NEEDS = {
    "email": re.compile(r"@|\bat\b", re.I), "phone": re.compile(r"(?:\D*\d){7}"), "id_number": re.compile(r"(?:\D*\d){5}"), "person": re.compile(r"[^\W\d_]{2}"),
}


def mentions(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """(kind, begin, end) of the mentions in each text, in order."""
    chains, owner, cut = [], [], []
    for n, text in enumerate(texts):
        ts = words(text)
        for a in range(0, len(ts), CHAIN):
            lo, hi = max(0, a - MARGIN), min(len(ts), a + CHAIN + MARGIN)
            chains.append(ts[lo:hi])
            owner.append(n)
            cut.append((a - lo, min(CHAIN, len(ts) - a)))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not chains:
        return out
    batch = Batch(chains)
    best = field.decode(batch)
    begin = np.concatenate([[0], np.cumsum(batch.lengths)])
    marked: list[list[int]] = [[] for _ in texts]
    for c, n in enumerate(owner):
        skip, size = cut[c]
        marked[n] += best[begin[c] + skip : begin[c] + skip + size].tolist()
    for n, labels in enumerate(marked):
        if not any(labels):
            continue
        open_: list | None = None
        for (_, a, b), label in zip(tokens(texts[n]), labels):
            name = LABELS[label]
            if open_ and name == f"I-{open_[0]}":
                open_[2] = b
                continue
            if open_:
                out[n].append(tuple(open_))
            open_ = [name[2:], a, b] if label else None
        if open_:
            out[n].append(tuple(open_))
        out[n] = [m for m in out[n] if m[0] not in _NEEDS or _NEEDS[m[0]].search(texts[n][m[1] : m[2]])]
    return out


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each mention replaced by its kind in brackets; all else is as it was."""
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def resume_texts(resumes: DataFrame) -> DataFrame:
    """candidate_id, field, item_no, text of the fields of resumes that are searched; null and blank texts are left out."""
    one = lambda field, no, text: F.struct(F.lit(field).alias("field"), no.cast("int").alias("item_no"), text.alias("text"))
    many = lambda column, field: F.coalesce(F.transform(column, lambda x, i: one(field, i, x["description"])), F.array().cast("array<struct<field:string,item_no:int,text:string>>"))
    every = F.concat(F.array(one("candidate_name", F.lit(0), F.col("candidate_name"))), many("experience", "experience.description"), many("projects", "projects.description"))
    return resumes.select("candidate_id", F.explode(every).alias("x")).select("candidate_id", "x.*").where("length(trim(text)) > 0")


def scan(texts: DataFrame, name_field: str = "candidate_name") -> DataFrame:
    """texts (candidate_id, field, item_no, text) with ``found`` (kind, nth of its kind in the text, begin, end) and ``redacted``.

    In the field of the name itself persons are no mentions. Every row comes back once; texts are searched whole,
    however long. begin and end count characters from 0.
    """
    spark = texts.sparkSession
    ship(spark)
    field = trained()
    kept = spark.sparkContext.broadcast((field.weight.astype(np.float16), field.step))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Field()
        f.weight, f.step = kept.value[0].astype(np.float32), kept.value[1]
        for whole in batches:
            for a in range(0, len(whole), 2_000):
                b = whole.iloc[a : a + 2_000].copy()
                rows = b["text"].tolist()
                hits = mentions(f, rows)
                hits = [[m for m in ms if m[0] != "person"] if name == name_field else ms for ms, name in zip(hits, b["field"])]
                b["found"] = [counted(ms) for ms in hits]
                b["redacted"] = [redact(t, ms) for t, ms in zip(rows, hits)]
                yield b

    schema = "candidate_id string, field string, item_no int, text string, found array<struct<kind:string,nth:int,begin:int,end:int>>, redacted string"
    return spread(texts.select("candidate_id", "field", "item_no", "text")).mapInPandas(search, schema)


def counted(mentions: list[tuple[str, int, int]]) -> list[dict]:
    """The mentions of a text, each with its number among those of its kind."""
    seen: dict[str, int] = {}
    out = []
    for kind, begin, end in mentions:
        seen[kind] = seen.get(kind, 0) + 1
        out.append({"kind": kind, "nth": seen[kind], "begin": begin, "end": end})
    return out


def numbered(scanned: DataFrame) -> DataFrame:
    """candidate_id, field, item_no, kind, nth: every mention, counted from 1 within its text and kind."""
    return scanned.select("candidate_id", "field", "item_no", F.explode("found").alias("x")).select("candidate_id", "field", "item_no", "x.kind", "x.nth")


def found(resumes: DataFrame) -> DataFrame:
    """candidate_id, field, item_no, kind, nth of every mention in resumes.

    Null lists and null, empty and blank texts hold no mention; long ones are searched whole. Equal mentions in one text
    are counted one by one; repeated rows count once. Other columns are not read. An empty table gives an empty result.
    """
    return numbered(scan(resume_texts(resumes))).distinct()


def redacted(resumes: DataFrame) -> DataFrame:
    """candidate_id, field, item_no, redacted: the texts with typed placeholders."""
    return scan(resume_texts(resumes)).select("candidate_id", "field", "item_no", "redacted").distinct()
