"""Passages of evaluation items inside documents: q-gram counts in diagonal bands, then banded alignment of words.

The items are a stated query set that is held against every document, in blocks of bounded size. Documents are read
whole, once a block, and stay where they are (a table in fewer parts than there are cores is spread first); what comes
out is one row per document and item.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, spread

#: Characters of a q-gram; bands of diagonals are BAND wide and begin every BAND / 2.
Q, BAND = 6, 64
#: Least words of an item that count as a passage.
WORDS = 12
#: Words that may be edited in any WORDS words of a passage, its ends aside.
EDITS = 3
#: Words of drift that an alignment may have to either side.
DRIFT = 14
#: Worth of a matched, a changed and a dropped or added word, and the least worth of a passage.
MATCH, CHANGED, GAP = 2, -2, -1
#: Worth from which an alignment of any length is a passage.
LEAST_WORTH = 20
#: Worth a word from which a passage has but few edits: one in six words.
DENSE = 4 / 3
#: Letters handled at once, and letters of items in a block.
CHUNK, BLOCK = 400_000, 4_000_000
#: Slots that bands are counted in; a power of two.
SLOTS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_HYPHEN = re.compile(r"(?<=\w)[-­]\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case, signs in their usual form, words broken at a line end put together."""
    return _HYPHEN.sub("", unicodedata.normalize("NFKC", text).lower())


def words_of(text: str) -> list[str]:
    """Words in lower case, without punctuation; words broken at a line end are put together."""
    return _WORD.findall(folded(text))


@functools.cache
def _letters() -> np.ndarray:
    """Which code points belong to words."""
    return np.array([chr(n).isalnum() for n in range(sys.maxunicode + 1)])


def least_hits(sizes: np.ndarray) -> np.ndarray:
    """Of every WORDS words in a row, given their letters: the q-grams that stay whatever EDITS words between are changed.

    This is the q-gram lemma, counted out: the words left between the edited ones keep the q-grams that lie within them.
    An added word does no more than a changed one beside it, so it is covered.
    """
    if len(sizes) < WORDS:
        return np.empty(0, np.int64)
    letters = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes) - WORDS + 1)
    least = np.full(len(at), np.iinfo(np.int64).max)
    for edited in combinations(range(1, WORDS - 1), EDITS):
        ends = (-1, *edited, WORDS)
        kept = sum(np.maximum(letters[at + b] - letters[at + a + 1] - Q + 1, 0) for a, b in zip(ends, ends[1:]))
        np.minimum(least, kept, out=least)
    return np.maximum(least, 1)


def enough(worth: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether an alignment is a passage: what WORDS words with EDITS of them changed are worth, more for longer ones up to 20."""
    return worth >= np.clip(words, WORDS, LEAST_WORTH)


def _hashes(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h = h * _BASE + codes[k : k + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class _Lines:
    """Texts as one row of letters, with the words' places; no word is a Python object here."""

    def __init__(self, texts: list[str]):
        whole = folded("\0".join(t.replace("\0", " ") for t in texts))
        self.texts = whole.split("\0")
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _letters()[codes]
        at = np.flatnonzero(inside)
        self.codes = codes[at].astype(np.uint64)
        self.line = np.cumsum(codes == 0)[at]
        self.lengths = np.bincount(self.line, minlength=len(texts)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.word_at = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else at  # a word begins after a gap
        self.counts = np.bincount(self.line[self.word_at], minlength=len(texts)).astype(np.int64)
        self.first_word = np.concatenate([[0], np.cumsum(self.counts)])

    def words(self, n: int) -> list[str]:
        return _WORD.findall(self.texts[n])

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, line and place in the row of every q-gram that lies within one line."""
        h = _hashes(self.codes)
        n = len(h)
        place = np.flatnonzero(self.line[:n] == self.line[Q - 1 : Q - 1 + n])
        return h[place], self.line[place], place


class Index:
    """Q-grams and words of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        words = [words_of(t) for _, t in items]
        lines = _Lines([" ".join(w) for w in words])
        h, line, place = lines.grams()
        order = np.argsort(h, kind="stable")
        self.keys, begin, count = np.unique(h[order], return_index=True, return_counts=True)
        self.begin, self.count = begin.astype(np.int64), count.astype(np.int64)
        self.item, self.at = line[order].astype(np.int64), (place - lines.starts[line])[order].astype(np.int64)
        self.shown = np.zeros(1 << 22, bool)
        self.shown[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.most = max([len(w) for w in words], default=0)
        self.table = np.full((len(items), max(self.most, 1)), -1, np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        for n, ws in enumerate(words):
            self.table[n, : len(ws)] = [self.vocabulary[w] for w in ws]
        self.word_begin = lines.word_at - np.repeat(lines.starts, self.sizes) if len(items) else np.empty(0, np.int64)
        self.first_word = lines.first_word
        self.letters = int(lines.lengths.max(initial=0))
        # Of every WORDS words in a row of an item: where their letters begin, their last q-gram, and how many stay.
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        each = [least_hits(np.diff(np.append(self.word_begin[a:b], lines.lengths[n]))) for n, (a, b) in enumerate(zip(ends, ends[1:]))]
        self.windows = np.array([len(x) for x in each], np.int64)
        self.first_window = np.concatenate([[0], np.cumsum(self.windows)])[:-1]
        self.stay = np.concatenate([*each, np.empty(0, np.int64)])
        self.need = np.array([x.min(initial=np.iinfo(np.int32).max) for x in each], np.int64)
        first = np.concatenate([*[np.arange(a, a + n) for a, n in zip(ends, self.windows)], np.empty(0, np.int64)])
        after = np.append(self.word_begin, 0)[first + WORDS] if len(first) else first
        last = np.isin(first + WORDS, ends[1:])  # these end where their item ends
        owner = np.repeat(np.arange(len(items)), self.windows)
        self.begins, self.lasts = self.word_begin[first], np.where(last, lines.lengths[owner], after) - Q
        self.reach = int((self.lasts - self.begins).max(initial=0))


_BUILT: dict[str, Index] = {}


def built(name: str, block) -> Index:
    """The index of a broadcast block, built once in a worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(block.value)
    return _BUILT[name]


def candidates(index: Index, lines: _Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, item and word diagonal of every band that keeps enough q-grams of an item."""
    none = np.empty(0, np.int64)
    h, line, place = lines.grams()
    seen = index.shown[(h >> np.uint64(42)).astype(np.int64)]
    h, line, place = h[seen], line[seen], place[seen]
    if not len(h):
        return none, none, none
    at = np.searchsorted(index.keys, h)
    at[at == len(index.keys)] = 0
    same = index.keys[at] == h
    at, line, place = at[same], line[same], place[same]
    n = index.count[at]
    of = np.repeat(index.begin[at] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    # A line that holds fewer q-grams of an item than a passage keeps is left out before anything else is listed of it.
    many = len(index.ids)
    item = index.item[of]
    pair = np.repeat(line * many, n) + item
    full = np.flatnonzero((np.bincount(pair, minlength=len(lines.lengths) * many) >= np.tile(index.need, len(lines.lengths)))[pair])
    hit = np.repeat(np.arange(len(at)), n)[full]
    item, there, line, place, pair = item[full], index.at[of[full]], line[hit], place[hit], pair[full]
    if not len(item):
        return none, none, none
    diagonal = place - lines.starts[line] - there
    band = diagonal // (BAND // 2)  # from a fixed diagonal, so that it does not matter what comes together in a chunk
    band -= int(band.min())
    wide = int(band.max()) + 2
    key = pair * wide + band
    # Bands are counted in slots that some of them share, which can only be too much: what is too little even so goes unsorted.
    slot = lambda k: (k * 0x9E3779B1 >> 12) & (SLOTS - 1)
    seen = np.bincount(slot(key), minlength=SLOTS)
    likely = np.flatnonzero(seen[slot(key)] + np.maximum(seen[slot(key - 1)], seen[slot(key + 1)]) >= index.need[item])
    if not len(likely):
        return none, none, none
    key, item, there, line, place = key[likely], item[likely], there[likely], line[likely], place[likely]
    shift = index.letters + index.reach + 1
    told = np.concatenate([key, key + 1]) * shift + np.concatenate([there, there])  # the band that begins here, and the one that began before
    order = np.argsort(told, kind="stable")
    told = told[order]
    fresh = np.append(True, told[1:] != told[:-1])
    told, order = told[fresh], order[fresh] % len(key)
    # Regions of a band that hold what the least demanding words of the item keep, ...
    need = index.need[item[order]]
    until = np.arange(len(told)) + need - 1
    near = (until < len(told)) & (told[np.minimum(until, len(told) - 1)] - told <= index.reach)
    keys = np.unique(told[near] // shift)
    if not len(keys):
        return none, none, none
    # ... and of these, the words in a row that keep what they themselves must.
    owner = keys // wide % many
    each = index.windows[owner]
    window = np.repeat(index.first_window[owner] - np.concatenate([[0], np.cumsum(each)])[:-1], each) + np.arange(each.sum())
    base = np.repeat(keys, each) * shift
    low, high = np.searchsorted(told, base + index.begins[window]), np.searchsorted(told, base + index.lasts[window], "right")
    good = np.flatnonzero(high - low >= index.stay[window])
    if not len(good):
        return none, none, none
    _, one = np.unique(base[good], return_index=True)
    middle = order[(low[good[one]] + high[good[one]]) // 2]  # the diagonal in words, at the middle hit
    line, item, place, there = line[middle], item[middle], place[middle], there[middle]
    doc_word = np.searchsorted(lines.word_at, place, "right") - 1 - lines.first_word[line]
    stop = np.searchsorted(index.word_begin + 1_000_000_000 * np.repeat(np.arange(many), index.sizes), there + 1_000_000_000 * item, "right") - 1
    drift = doc_word - (stop - index.first_word[item])
    # Neighbouring bands with the same hits ask for the same alignment: once is enough.
    least = int(drift.min())
    span = int(drift.max()) - least + 1
    asked = np.unique((line * many + item) * span + (drift - least))
    pair, drift = asked // span, asked % span + least
    return pair // many, pair % many, drift


def align(index: Index, item: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Worth and length in item words of each candidate's local alignment that is most worth for its length, within DRIFT
    of its diagonal, and the document's word it ends with.

    words: the documents' words as numbers of the vocabulary; begin and size: where a candidate's document lies in them.
    """
    order = np.argsort(-index.sizes[item], kind="stable")  # long items first, so that those that end can be left behind
    item, begin, size, diagonal = item[order], begin[order], size[order], diagonal[order]
    lengths = index.sizes[item]
    most, span = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    lead = np.full(len(item), -(1 << 30), np.int64)
    last = np.zeros(len(item), np.int64)
    width = 2 * DRIFT + 1
    k = np.arange(width, dtype=np.int32)
    unit, low = np.int32(1 << 16), np.int32((1 << 16) - 1)  # worth in the upper half, where it began in the lower
    gap, match, changed = np.int32(GAP) * unit, np.int32(MATCH) * unit, np.int32(CHANGED) * unit
    gap_row = -gap * k
    state = np.zeros((len(item), width), np.int32)
    final = max(len(words) - 1, 0)
    for i in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -i, "left"))  # items that still have a word i
        state = state[:n]
        j = (i - DRIFT + diagonal[:n])[:, None] + k
        inside = (j >= 0) & (j < size[:n, None])
        here = words[np.minimum(np.maximum(begin[:n, None] + j, 0), final)]
        equal = inside & (here == index.table[item[:n], i][:, None])
        # An alignment may begin here; the earlier of two equal beginnings is the longer one.
        through = np.where(state >= unit, state, low - np.int32(i)) + np.where(equal, match, changed)
        row = np.zeros_like(state)
        row[:, :-1] = state[:, 1:] + gap
        np.maximum(row, through, out=row, where=inside)
        row += gap_row
        np.maximum.accumulate(row, axis=1, out=row)
        row -= gap_row
        row[row < unit] = 0
        state = row
        ending = np.where(equal, state, 0)  # an alignment ends with a matched word
        column = ending.argmax(axis=1)
        best = ending[np.arange(n), column].astype(np.int64)
        length = i - (int(low) - (best & int(low))) + 1
        worth = best >> 16
        ahead = worth - np.clip(length, WORDS, LEAST_WORTH)
        better = (worth > 0) & (length >= WORDS) & (ahead > lead[:n])
        lead[:n][better] = ahead[better]
        most[:n][better], span[:n][better] = worth[better], length[better]
        last[:n][better] = (i - DRIFT + diagonal[:n] + column)[better]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return most[back], span[back], last[back]


def shared_grams(index: Index, regions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Region, item and how many of the region's q-grams the item holds, wherever in it; pairs without any are left out."""
    lines = _Lines(regions)
    h, line, place = lines.grams()
    if not len(h) or not len(index.keys):
        return (np.empty(0, np.int64),) * 3
    at = np.searchsorted(index.keys, h)
    at[at == len(index.keys)] = 0
    same = index.keys[at] == h
    at, line, place = at[same], line[same], place[same]
    n = index.count[at]
    of = np.repeat(index.begin[at] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    many = max(len(index.ids), 1)
    once = np.unique(np.repeat(place, n) * many + index.item[of])
    where = np.searchsorted(lines.starts, once // many, "right") - 1
    pair, count = np.unique(where * many + once % many, return_counts=True)
    return pair // many, pair % many, count


def find(index: Index, ids: list, texts: list[str]) -> list[tuple]:
    """(id, item id, worth, words, region, own, most) of every passage found in texts.

    A passage that is worth less than LEAST_WORTH, or less than DENSE a word, comes with its region of the text, and with how many of the region's
    q-grams its item and the best of all items hold: if another holds more, the region is that item's and only sounds
    like this one. For other passages these are null.
    """
    lines = _Lines(texts)
    line, item, diagonal = candidates(index, lines)
    out: list[tuple] = []
    if not len(line):
        return out
    used = np.unique(line)
    words = {int(n): lines.words(n) for n in used}
    counts = lines.counts[used]
    begins = np.concatenate([[0], np.cumsum(counts)])
    get = index.vocabulary.get
    numbers = np.fromiter((get(w, -2) for n in used for w in words[int(n)]), np.int64, int(counts.sum()))
    place = np.searchsorted(used, line)
    doubtful, regions = [], []
    for a in range(0, len(line), 4096):
        part = slice(a, a + 4096)
        worth, span, last = align(index, item[part], numbers, begins[place[part]], counts[place[part]], diagonal[part])
        for k in np.flatnonzero((span > 0) & enough(worth, span)):
            row = (ids[line[a + k]], int(index.ids[item[a + k]]), int(worth[k]), int(span[k]))
            if worth[k] >= max(LEAST_WORTH, DENSE * span[k]):
                out.append((*row, None, None, None))
            else:
                doubtful.append((row, int(item[a + k])))
                regions.append(" ".join(words[int(line[a + k])][max(0, last[k] - span[k] + 1) : last[k] + 1]))
    where, which, count = shared_grams(index, regions)
    most = np.zeros(len(regions), np.int64)
    np.maximum.at(most, where, count)
    own = dict(zip(zip(where.tolist(), which.tolist()), count.tolist()))
    return out + [(*row, r, own.get((n, i), 0), int(most[n])) for n, ((row, i), r) in enumerate(zip(doubtful, regions))]


def _pieces(ids: list, texts: list[str | None], over: int) -> Iterator[tuple[list, list[str]]]:
    """Texts in chunks of bounded size; a very long text comes in pieces that overlap by ``over`` words."""
    held, letters, out = [], 0, []
    step = 30_000
    for key, text in zip(ids, texts):
        if not text:
            continue
        pieces = [text]
        if len(text) > CHUNK:
            words = words_of(text)
            pieces = [" ".join(words[a : a + step + over]) for a in range(0, max(len(words) - over, 1), step)]
        for piece in pieces:
            held.append(key)
            out.append(piece)
            letters += len(piece)
            if letters > CHUNK:
                yield held, out
                held, letters, out = [], 0, []
    if held:
        yield held, out


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (id, text) in blocks of BLOCK letters, one at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in items.distinct().orderBy("id", "text").toLocalIterator():
        block.append((r["id"], r["text"]))
        held += len(r["text"])
        if held > BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, worth, words: every document that holds a passage of an item, with the longest passage.

    A passage has WORDS words of the item or more, from the first to the last it shares with the text, and is worth
    enough. Below LEAST_WORTH, or with more than one edit in six words, it counts only if no other item holds more
    q-grams of that region of the text.
    Null and empty texts hold nothing. Texts are read whole, however long. Repeated rows and equal passages come out
    once. Items shorter than WORDS words cannot be found; items that agree in text are each named. Columns besides the
    named ones are not read. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    ship(spark)
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and length(text) > 0")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    docs = spread(docs)
    schema = "doc_id long, item_id long, worth int, words int, region string, own int, most int"
    hits = spark.createDataFrame([], schema)
    blocks = []
    for block in item_blocks(asked):
        kept, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        blocks.append((kept, name))

        def scan(batches: Iterator[pd.DataFrame], kept=kept, name=name) -> Iterator[pd.DataFrame]:
            index = built(name, kept)
            for b in batches:
                for ids, texts in _pieces(b["doc_id"].tolist(), b["text"].tolist(), 2 * index.most):
                    rows = find(index, ids, texts)
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "worth", "words", "region", "own", "most"]).astype({"own": "Int64", "most": "Int64"})

        hits = hits.unionByName(docs.mapInPandas(scan, schema))
    if len(blocks) > 1:  # the best of all items is that of all blocks
        hits = cut(hits.withColumn("row", F.monotonically_increasing_id()))
        doubtful = hits.where("region is not null").select("row", "region")
        others = spark.createDataFrame([], "row long, elsewhere int")
        for kept, name in blocks:

            def look(batches: Iterator[pd.DataFrame], kept=kept, name=name) -> Iterator[pd.DataFrame]:
                index = built(name, kept)
                for b in batches:
                    where, _, count = shared_grams(index, b["region"].tolist())
                    most = np.zeros(len(b), np.int64)
                    np.maximum.at(most, where, count)
                    yield pd.DataFrame({"row": b["row"], "elsewhere": most})

            others = others.unionByName(doubtful.mapInPandas(look, "row long, elsewhere int"))
        hits = hits.join(others.groupBy("row").agg(F.max("elsewhere").alias("elsewhere")), "row", "left").withColumn("most", F.greatest("most", "elsewhere"))
    sure = F.col("region").isNull() | (F.col("most") <= F.col("own"))
    return hits.where(sure).groupBy("doc_id", "item_id").agg(F.max("worth").alias("worth"), F.max("words").alias("words"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every leak; nulls, empty tables and repeated rows as in leaks."""
    return leaks(documents, items).select("doc_id", "item_id")


def item_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, n_docs: the items that leaked, and into how many documents."""
    return found(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
