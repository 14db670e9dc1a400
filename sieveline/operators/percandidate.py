"""What is asked of a candidate, looked up in a row that holds the candidate: exact skills, BM25+ chunks and worths.

Candidates times requirements are many times the tables they come from, so they are never shuffled or stored: a row has
the roles of a candidate, and goes through one Arrow pass that knows nothing but that row and the lists these roles ask
for, which the workers have or, where they are too large for that, the row. The rules are those of matching and
retrieval; texts and roles are read once for each worker, not once for each pair.
"""

from __future__ import annotations

import difflib
import math
import re
import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import DEGREE_TIERS, OPEN_FIELDS, TITLE_STOPWORDS
from ..session import BROADCAST_BYTES, fits, ship, small

# Constants of BM25+, and skills that stand for each other.
K1, B, DELTA = 1.5, 0.75, 1.0
EQUAL_SKILLS = (("etl", "elt"),)

# White space as strip of functions.text takes it off.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WORDS = re.compile("[a-z0-9]+")
_TOKENS = re.compile(r"[a-z0-9]+|[^a-z0-9\s]")
_GAP = re.compile(r"[ \t\n\x0b\f\r]")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

#: Texts a worker remembers; beyond these it begins anew.
REMEMBERED = 200_000
#: Bytes of lists, as JSON, that are sent to the workers; as columns they take about half of it.
SENT_BYTES = 128 << 20
#: Rows of a result that go back at once.
ROWS = 20_000


def contains_word(haystack: str, needle: str) -> bool:
    """contains_word of functions.text."""
    at = haystack.find(needle) if needle else -1
    while at >= 0:
        end = at + len(needle)
        if (at == 0 or haystack[at - 1] not in _LETTERS) and (end == len(haystack) or haystack[end] not in _LETTERS):
            return True
        at = haystack.find(needle, at + 1)
    return False


def _first_token(text: str) -> str:
    """A token that every text with this one at word bounds has."""
    found = _WORDS.search(text)
    return found[0] if found else text[:1]


class Requirement:
    """A requirement, read once; odd are signs that it may be found by and that are none of its words."""

    __slots__ = ("norm", "tokens", "variants", "terms", "words", "text", "odd")

    def __init__(self, text: str) -> None:
        self.text, self.norm = text, text.strip(_SPACE).lower()
        same = [self.norm, *[b if self.norm == a else a for a, b in EQUAL_SKILLS if self.norm in (a, b)]]
        self.variants = [(v, _first_token(v)) for v in same]
        self.tokens = frozenset(_TOKENS.findall(self.norm))
        found = [sys.intern(w) for w in _WORDS.findall(text.lower())]
        self.terms, self.words = tuple(Counter(found).items()), frozenset(found)
        self.odd = self.tokens.union(*self.variants) - self.words
        if self.odd <= {self.norm}:  # words and nothing else: they tell as much
            self.odd = frozenset() if self.words else self.odd


class Skill:
    """A skill that is not blank, read once."""

    __slots__ = ("text", "norm", "many", "tokens", "first")

    def __init__(self, text: str) -> None:
        self.text, self.norm = text, text.strip(_SPACE).lower()
        self.many = bool(_GAP.search(self.norm))
        self.tokens, self.first = frozenset(_TOKENS.findall(self.norm)), _first_token(self.norm)


class Memory(dict):
    """What was made of a text, up to REMEMBERED of them."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, text: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[text] = made = self.make(text)
        return made


class Candidate:
    """Skills and chunks of one candidate, and what requirements find in them."""

    def __init__(self, skills: list[Skill], chunks: list[tuple[int, str]], top_k: int = 3, min_score: float = 0.0, delta_on_absent: bool = True) -> None:
        self.skills, self.top_k, self.min_score, self.absent = skills, top_k, min_score, delta_on_absent
        self.equal: dict[str, int] = {}
        self.holding: dict[str, list[int]] = {}
        self.inside: dict[str, list[int]] = {}
        for pos, s in enumerate(skills):
            self.equal.setdefault(s.norm, pos)
            for t in s.tokens:
                self.holding.setdefault(t, []).append(pos)
            if s.many:
                self.inside.setdefault(s.first, []).append(pos)
        self.numbers = [no for no, _ in chunks]
        self.held = [Counter(_WORDS.findall(text.lower())) for _, text in chunks]
        lengths = [c.total() for c in self.held]
        mean = sum(lengths) / len(lengths) if lengths else 0.0
        self.norms = [K1 * (1 - B + B * n / mean) if mean else 0.0 for n in lengths]
        self.places: dict[str, list[int]] = {}
        for i, c in enumerate(self.held):
            for t in c:
                self.places.setdefault(t, []).append(i)
        self.known = set(self.places).union(self.equal, self.holding, self.inside)
        self.parts: dict[tuple[str, int], tuple[float, list[float]]] = {}
        self.found: dict[tuple, list[tuple[int, float]]] = {}
        self.read: dict[tuple, set[str] | None] = {}
        self.joined: dict[frozenset[int], set[str] | None] = {}

    def near(self, asked: Iterable[Requirement]) -> list[Requirement]:
        """Those of which skills or chunks hold something; neither exact nor best finds anything for the others."""
        strange = self.known.isdisjoint
        return [r for r in asked if not strange(r.words) or r.odd and not strange(r.odd)]

    def part(self, term: tuple[str, int]) -> tuple[float, list[float]]:
        """What a term of the candidate's chunks adds: to all of them, and to each."""
        word, times = term
        places = self.places[word]
        idf = times * math.log((len(self.held) + 1.0) / len(places))
        least, each = 0.0 if self.absent else DELTA, [0.0] * len(self.held)
        for i in places:
            n = self.held[i][word]
            each[i] = idf * (least + n * (K1 + 1) / (self.norms[i] + n))
        self.parts[term] = made = (idf * DELTA, each)
        return made

    def exact(self, asked: Requirement) -> str | None:
        """exact_skill of matching."""
        if not asked.norm:
            return None
        if len(asked.variants) == 1:
            at = self.equal.get(asked.norm)
        else:
            at = min((p for v, _ in asked.variants if (p := self.equal.get(v)) is not None), default=None)
        if at is None:
            hits = [p for v, t in asked.variants if t in self.holding for p in self.holding[t] if contains_word(self.skills[p].norm, v)]
            if self.inside:
                hits += [p for t in asked.tokens if t in self.inside for p in self.inside[t] if contains_word(asked.norm, self.skills[p].norm)]
            if not hits:
                return None
            at = min(hits)
        return self.skills[at].text

    def terms(self, asked: Requirement) -> tuple[tuple[str, int], ...]:
        """Its terms that some chunk holds."""
        places = self.places
        return tuple([x for x in asked.terms if x[0] in places])

    def best(self, asked: Requirement) -> list[tuple[int, float]]:
        """(chunk, score) of the best chunks, by their places; scores are told apart to nine digits, equal ones keep the order of chunks."""
        return self.best_of(self.terms(asked))

    def best_of(self, terms: tuple[tuple[str, int], ...]) -> list[tuple[int, float]]:
        if not terms:
            return []
        if terms not in self.found:
            floor, scores = 0.0, [0.0] * len(self.held)
            for term in terms:
                least, each = self.parts.get(term) or self.part(term)
                floor += least
                scores = [a + b for a, b in zip(scores, each)]
            if self.absent:
                top = [(-round(x, 9), i, x) for i, score in enumerate(scores) for x in (score + floor,)]
            else:
                held = set().union(*[self.places[word] for word, _ in terms])
                top = [(-round(x, 9), i, x) for i, x in enumerate(scores) if i in held]
            top.sort()
            self.found[terms] = [(i, x) for _, i, x in top[: self.top_k] if x > self.min_score]
        return self.found[terms]

    def shown(self, asked: Requirement) -> set[str] | None:
        """The words of the best chunks; None if there are none."""
        terms = self.terms(asked)
        if terms not in self.read:
            at = frozenset([i for i, _ in self.best_of(terms)])
            if at not in self.joined:
                self.joined[at] = set().union(*[self.held[i] for i in at]) if at else None
            self.read[terms] = self.joined[at]
        return self.read[terms]


_ASKED, _SKILLS = Memory(Requirement), Memory(Skill)


def skills_of(texts: list[str | None] | None) -> list[Skill]:
    return [s for t in texts or () if t is not None and (s := _SKILLS[t]).norm]


class ExactSkills:
    """(candidate_id, requirement, matched) of rows with requirements and skills."""

    schema = "candidate_id string, requirement string, matched string"

    def __call__(self, row: dict) -> list[tuple]:
        me = Candidate(skills_of(row["skills"]), [])
        return [(row["candidate_id"], r, None if r is None else me.exact(_ASKED[r])) for r in row["requirements"]]


class BestChunks:
    """(candidate_id, requirement, chunk_no, score, rnk) of rows with requirements and chunks (chunk_no, text)."""

    schema = "candidate_id string, requirement string, chunk_no int, score double, rnk int"

    def __init__(self, top_k: int, min_score: float, delta_on_absent: bool) -> None:
        self.how = (top_k, min_score, delta_on_absent)

    def __call__(self, row: dict) -> list[tuple]:
        me = Candidate([], [(c["chunk_no"], c["text"]) for c in row["chunks"]], *self.how)
        return [(row["candidate_id"], r, me.numbers[i], score, n) for r in row["requirements"] for n, (i, score) in enumerate(me.best(_ASKED[r]), 1)]


class Role:
    """A role as a kernel reads it once: its requirements, where those of each category begin and end, and what more it keeps of the row."""

    __slots__ = ("role_id", "asked", "bounds", "more")

    def __init__(self, row: dict, categories: tuple[str, ...], more: tuple = ()) -> None:
        self.role_id, self.more = row["role_id"], more
        asked, bounds = [], []
        for c in categories:
            asked += [_ASKED[r] for r in row[c] or () if r is not None]
            bounds.append((bounds[-1][1] if bounds else 0, len(asked)))
        self.asked, self.bounds = tuple(asked), tuple(bounds)


class Worths:
    """The averages of a candidate's lists in each role, and the requirements of some lists by what they are worth.

    Rows have skills, chunks and roles, each made by ``role`` of a row with an array for each category. The result has
    candidate_id, role_id, the average of each category (null without requirements) and, for each category in ``listed``,
    the arrays named there: matched, missing, gate_missing. ``level`` tells (level, share) of the words of a requirement
    and of its evidence.
    """

    def __init__(self, categories: tuple[str, ...], listed: dict[str, tuple[str, ...]], level: Callable, worths: dict[str, float], gate: float) -> None:
        self.categories, self.listed, self.level, self.worths, self.gate = categories, listed, level, worths, gate
        self.schema = ", ".join(["candidate_id string, role_id string", *[f"{c} double" for c in categories], *[f"{c}_{n} array<string>" for c, names in listed.items() for n in names]])

    def role(self, row: dict) -> Role:
        return Role(row, self.categories)

    def __call__(self, row: dict) -> list[tuple]:
        return [(row["candidate_id"], role.role_id, *values) for role, values in self.each(row)]

    def each(self, row: dict) -> Iterator[tuple[Role, list]]:
        me = Candidate(skills_of(row["skills"]), [(c["chunk_no"], c["text"]) for c in row["chunks"]])
        worth = dict.fromkeys([r for role in row["roles"] for r in role.asked], 0.0)
        for r in me.near(worth):
            worth[r] = self.worth(me, r)
        of, gate = worth.__getitem__, self.gate
        shown = [(n, name) for n, c in enumerate(self.categories) for name in self.listed.get(c, ())]
        for role in row["roles"]:
            found = list(map(of, role.asked))
            values: list = [reduce(add, found[a:b], 0.0) / (b - a) if b > a else None for a, b in role.bounds]  # not sum, which rounds in another way
            for n, name in shown:
                a, b = role.bounds[n]
                both = zip(role.asked[a:b], found[a:b])
                values.append([r.text for r, x in both if x < gate] if name == "gate_missing" else [r.text for r, x in both if (x > 0 if name == "matched" else x == 0)])
            yield role, values

    def worth(self, me: Candidate, asked: Requirement) -> float:
        if me.exact(asked) is not None:
            return 1.0
        shown = me.shown(asked)
        return 0.0 if shown is None else self.worths[self.level(asked.words, shown)[0]]


# As in functions.text.
_OPEN = re.compile("|".join(OPEN_FIELDS))
_OTHER = re.compile(r"[^a-z0-9 \t\n\x0b\f\r]")
_EITHER = re.compile(r"\b(?:or|and)\b")
_PIECES = re.compile(r"[\u2014\-/|]")
_SIGNS = re.compile(r"[-_/(),]")
_BLANKS = re.compile(f"[{_SPACE}]+")


def tier(level: str | None) -> str:
    """degree_tier of functions.text."""
    bare = re.sub("[^a-z0-9]", "", (level or "").lower())
    return next((name for name, keys in DEGREE_TIERS if any(k in bare for k in keys)), "other")


def alternatives(field: str | None) -> list[tuple[str, list[str]]] | None:
    """The fields that a required field leaves the choice of, whole and in words; None if it is open to all."""
    bare = _OTHER.sub(" ", (field or "").lower()).strip(_SPACE)
    if not bare or _OPEN.search(bare):
        return None
    return [(k, re.split(r"[ \t\n\x0b\f\r]+", k)) for x in _EITHER.split(bare) if len(k := x.strip(_SPACE)) >= 2]


def containment_norm(text: str) -> str:
    """containment_norm of functions.text."""
    return _BLANKS.sub(" ", _SIGNS.sub(" ", text.lower())).strip(_SPACE)


class Title:
    """A title, read once."""

    __slots__ = ("text", "plain", "words", "telling", "phrases")

    def __init__(self, text: str) -> None:
        self.text, self.plain = text, containment_norm(text)
        self.words = frozenset(_WORDS.findall(text.lower()))
        self.telling = self.words.difference(TITLE_STOPWORDS)
        parts = [p.strip(_SPACE) for p in [*_PIECES.split(text), text]]
        self.phrases = [n for p in parts if _GAP.search(p) and (n := containment_norm(p))]


_TIERS, _FIELDS, _BARE, _TITLES = Memory(tier), Memory(alternatives), Memory(lambda text: _OTHER.sub(" ", text.lower())), Memory(Title)


class Fits(Worths):
    """Worths, with what else a candidate's fit for a role is made of.

    Rows have also titles, education and total_years_experience; roles have target (the title), education_requirements,
    min_years_experience and asked. The result goes on with title_worth, education_met, total_years_experience,
    min_years_experience, blank (no title) and asked, by the rules of title_match and degree_met. ``reason`` is what the
    judge says for a share.
    """

    def __init__(self, *worths, reason: Callable[[float], str], bypass: float) -> None:
        super().__init__(*worths)
        self.reason, self.bypass = reason, bypass
        self.schema += ", title_worth double, education_met boolean, total_years_experience double, min_years_experience double, blank boolean, asked int"

    def role(self, row: dict) -> Role:
        degrees = tuple(((d or {}).get("degree_level"), (d or {}).get("field")) for d in row["education_requirements"] or ())
        return Role(row, self.categories, (row["target"] or "", degrees, row["min_years_experience"], row["asked"]))

    def __call__(self, row: dict) -> list[tuple]:
        titles = [_TITLES[t] for t in row["titles"]]
        texts = [(_TIERS[(e or {}).get("degree_level")], _BARE[((e or {}).get("degree_level") or "") + " " + ((e or {}).get("field") or "")]) for e in row["education"] or ()]
        tiers = {t for t, _ in texts}
        if titles:
            words = frozenset().union(*[t.words for t in titles])
            same = difflib.SequenceMatcher(None)
            same.set_seq2(titles[0].plain)
        worth: dict[str, float] = {}
        met: dict[tuple, bool] = {(): True}

        def titled(target: str) -> float:
            if not titles or not target:
                return 0.0
            role = _TITLES[target]
            same.set_seq1(role.plain)
            if same.real_quick_ratio() >= self.bypass and same.quick_ratio() >= self.bypass and (ratio := same.ratio()) >= self.bypass:
                return 1.0 if ratio == 1 else 0.85
            level, share = self.level(role.words, words)
            if self.worths[level] > 0:
                said, shown = containment_norm(self.reason(share)), containment_norm(" | ".join(t.text for t in titles))
                if any(p in said and p not in shown and p in role.plain for p in role.phrases):
                    level = "weak" if any(role.telling & t.telling for t in titles) else "none"
            return self.worths[level]

        def fits(degree: tuple) -> bool:
            wanted, fields = _TIERS[degree[0]], _FIELDS[degree[1]]
            if not (wanted == "other" or wanted in tiers or wanted == "bachelor" and not tiers.isdisjoint(("master", "phd"))):
                return False
            return fields is None or any(k in t or all(w in t for w in parts) for k, parts in fields for _, t in texts)

        out = []
        for role, values in self.each(row):
            target, degrees, least, asked = role.more
            if target not in worth:
                worth[target] = titled(target)
            if degrees not in met:
                met[degrees] = any(fits(d) for d in degrees)
            out.append((row["candidate_id"], role.role_id, *values, worth[target], met[degrees], row["total_years_experience"], least, not target, asked))
        return out


def parts_of(rows: DataFrame) -> int:
    """Parts for rows of candidates, so that every core has a share however few bytes there are."""
    spark = rows.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def roles_of(pairs: DataFrame) -> DataFrame:
    """candidate_id, roles: the distinct roles of each candidate in pairs (candidate_id, role_id)."""
    each = pairs.select("candidate_id", "role_id").where("role_id is not null").repartition(parts_of(pairs), "candidate_id")
    return each.groupBy("candidate_id").agg(F.collect_set("role_id").alias("roles"))


def fit_in_text(lists: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    return fits(lists.select(F.to_json(F.struct(*lists.columns)).alias("text")), most_bytes)


def asked_of(pairs: DataFrame, lists: DataFrame, is_small: bool | None = None) -> DataFrame:
    """candidate_id, roles: the distinct roles of each candidate in pairs (candidate_id, role_id), with the other columns of lists, which has a row for each role."""
    asked = F.struct("role_id", *[c for c in lists.columns if c != "role_id"])
    roles = roles_of(pairs).select("candidate_id", F.explode("roles").alias("role_id"))
    measured = fit_in_text(lists) if is_small is None else is_small
    return roles.join(small(lists, measured), "role_id").groupBy("candidate_id").agg(F.collect_list(asked).alias("roles"))


def requirements_of(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """candidate_id, requirements: what the roles of each candidate ask for, each once; lists has role_id and requirements, an array."""
    return asked_of(pairs, lists).select("candidate_id", F.array_distinct(F.flatten(F.transform("roles", lambda r: r["requirements"]))).alias("requirements"))


def gathered(asked: DataFrame) -> DataFrame:
    """candidate_id, requirements of rows (candidate_id, requirement)."""
    each = asked.select("candidate_id", "requirement").repartition(parts_of(asked), "candidate_id").groupBy("candidate_id").agg(F.collect_list(F.struct("requirement")).alias("x"))
    return each.select("candidate_id", F.transform("x", lambda x: x["requirement"]).alias("requirements"))


class Lists(dict):
    """The roles of a table of lists, by role_id, as a kernel reads them; each is read when it is first asked for."""

    def __init__(self, table: pa.Table, make: Callable[[dict], Role]) -> None:
        super().__init__()
        self.columns, self.make = {c: table[c].combine_chunks() for c in table.column_names}, make
        self.at = {role: n for n, role in enumerate(self.columns["role_id"].to_pylist())}

    def __missing__(self, role_id: str) -> Role | None:
        n = self.at.get(role_id)
        self[role_id] = made = None if n is None else self.make({c: x[n].as_py() for c, x in self.columns.items()})
        return made


#: The lists that a worker has at hand, under their name; those of one pass at a time.
_LISTS: dict[str, Lists] = {}


class SentLists:
    """The roles of ids, by lists that were sent to the workers; ids without a list are left out."""

    def __init__(self, lists: DataFrame, make: Callable[[dict], Role]) -> None:
        table, sink = lists.toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        self.kept, self.name, self.make = lists.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex, make

    def __call__(self, ids: list[str]) -> list[Role]:
        if self.name not in _LISTS:
            _LISTS.clear()
            _LISTS[self.name] = Lists(pa.ipc.open_stream(self.kept.value).read_all(), self.make)
        of = _LISTS[self.name]
        return [r for i in ids if (r := of[i]) is not None]


def passed_roles(pairs: DataFrame, lists: DataFrame, people: DataFrame, kernel: Worths) -> DataFrame:
    """kernel over the candidates of people with the roles they have in pairs (candidate_id, role_id) and lists (role_id, ...), both with a row for each.

    Lists that fit go to each worker once, and rows have the ids of roles only; else the lists go with the rows.
    """
    if not fit_in_text(lists, SENT_BYTES):
        return passed(asked_of(pairs, lists, is_small=False).join(people, "candidate_id"), kernel, lambda roles: [kernel.role(r) for r in roles])
    return passed(roles_of(pairs).join(people, "candidate_id"), kernel, SentLists(lists, kernel.role))


def passed(rows: DataFrame, kernel: Callable[[dict], list[tuple]], roles: Callable[[list], list[Role]] | None = None) -> DataFrame:
    """rows through kernel, which makes tuples in the order of its schema of each row, given as a dict; ``roles`` makes what the kernel has for roles."""
    spark = rows.sparkSession
    ship(spark)
    schema = to_arrow_schema(spark.createDataFrame([], kernel.schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for row in b.slice(at, 64).to_pylist():
                    if roles is not None:
                        row["roles"] = roles(row["roles"])
                    out += kernel(row)
                    if len(out) >= ROWS:
                        yield packed(out, schema)
                        out = []
        if out:
            yield packed(out, schema)

    return rows.mapInArrow(run, kernel.schema)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
