"""Variant spellings of persons' and firms' names, linked by a symmetric-delete index and an alignment of tokens.

Two spellings within an edit of each other share one of their deletions, so an equi-join on deletions finds them. Firms
are linked to the commonest spelling near them, never to each other; persons are compared only where education and the
deletion of a name part agree, and only one of several like records is compared. Pairs are written out at the end, from
groups that are cut into buckets.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, small, spread_small
from .assignment import assign
from .canonical import edits

# Legal forms and joining words of firms' names.
LEGAL = set("ltd limited inc incorporated llc llp gmbh ag plc group sa bv nv spa oy ab kg co corp corporation company holding holdings and und et the of".split())
# Lines of business and how firms write them.
LINES = {
    "pharma": "pharma pharmaceutical pharmaceuticals", "health": "health healthcare", "media": "media medien", "foods": "foods food", "energy": "energy energie energies",
    "logistics": "logistics logistik logistic logist", "consulting": "consulting consultancy consult consultants", "retail": "retail retailing", "financial": "financial finance fin financials",
    "insurance": "insurance ins insurances", "manufacturing": "manufacturing mfg manufacture", "engineering": "engineering eng engrg", "technologies": "technologies technology tech",
    "services": "services service svcs", "analytics": "analytics analytic", "software": "software", "partners": "partners", "systems": "systems system", "industries": "industries industry",
}
# Given names and their short forms.
NICKNAMES = """michael mike mick mikey; timothy tim timmy; dmitri dima mitya dmitry; andrew andy drew; margaret maggie meg peggy greta; robert bob rob bobby robbie; william bill will billy liam;
elizabeth liz beth lizzy eliza betty; katherine kate kathy katie kat; christopher chris kit; nicholas nick nico; anthony tony ant; matthew matt; daniel dan danny; benjamin ben benny;
samantha sam sammy; patricia pat patty trish; jennifer jen jenny; rebecca becky becca; victoria vicky tori vic; alexander alex sasha xander; joseph joe joey; frederick fred freddy; gregory greg;
richard rick dick rich; theodore ted theo teddy; susannah sue susie anna susan; francesca fran franny chessa; agnieszka aga agnes; svetlana sveta lana; tomasz tomek tom; johannes hannes jo johann hans;
guadalupe lupe lupita; ignacio nacho; rafael rafa raf; beatriz bea; vikram vik; jurgen juergen jorg; mohammed mo mohamed muhammad; olumide olu; deepika dee deepi; lakshmi laksh;
sunita suni; leila lei; priya pri; ingrid inga; noemie mimi; yusuf yus; omar omi; kenji ken; katarzyna kasia; edward ed eddie ned; james jim jamie; thomas tommy; stephen steve; charles charlie chuck"""
_GIVEN: dict[str, int] = {n: i for i, group in enumerate(NICKNAMES.replace("\n", " ").split(";")) for n in group.split()}
_INITIALS: dict[int, set[str]] = {}
_NEAR_GIVEN: dict[str, set[str]] = {}


def _index_given() -> None:
    for name, group in _GIVEN.items():
        _INITIALS.setdefault(group, set()).add(name[0])
        if len(name) >= 5:
            for gone in deletions(name):
                _NEAR_GIVEN.setdefault(gone, set()).add(name)


# What may stand beside a name.
BESIDE = set("mr mrs ms miss dr prof sir herr frau mba phd msc bsc ma md cpa pmp jr sr cv resume".split())

_ACRONYM = re.compile(r"^\s*[A-Z]{2,6}\s+-\s+")


def fold(text: str) -> str:
    """Lower case without accents."""
    t = text.lower().replace("ø", "o").replace("ß", "ss").replace("ł", "l").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def deletions(word: str, most: int = 1) -> set[str]:
    """The word and every form of it that lacks up to ``most`` letters."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


_index_given()


@functools.lru_cache(100_000)
def given_groups(part: str) -> frozenset[int]:
    """The given names, as groups of short forms, that a name part is or, mistyped, may be."""
    if part in _GIVEN:
        return frozenset([_GIVEN[part]])
    if not 4 <= len(part) <= 20:
        return frozenset()
    near = {name for gone in deletions(part) for name in _NEAR_GIVEN.get(gone, ())}
    return frozenset(_GIVEN[name] for name in near if edits(part, name, 1) <= 1)


#: Letters from which a name part may have two edits, and is indexed by two deletions.
TWO_EDITS = 7


def part_keys(part: str) -> set[str]:
    """What a name part is found by: its deletions, as many as same_part allows edits; short parts stand as they are.

    Of a long part only the first TWO_EDITS letters are indexed: two parts within two edits of each other have beginnings
    that share a deletion of two letters, for what the edits move across the end can be deleted there.
    """
    return {part} if len(part) < 4 else deletions(part) if len(part) < TWO_EDITS else deletions(part[:TWO_EDITS], 2)


_LINE_OF = {w: line for line, words in LINES.items() for w in words.split()}


def parse_firm(text: str) -> tuple[list[str], str, str] | None:
    """(name parts, line of business or '', a part that is cut short or '') of a firm's name."""
    t = fold(_ACRONYM.sub("", text))
    t = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", ""), t)
    parts, line, short = [], "", ""
    for w in re.findall(r"[^\W_]+\.?", t):
        bare = w.rstrip(".")
        if bare in LEGAL:
            continue
        if not line and (bare in _LINE_OF or len(bare) >= 5 and (near := _near_line(bare))):
            line = _LINE_OF.get(bare) or near
        elif w.endswith(".") and 3 <= len(bare) <= 6 and not short:
            short = bare
        else:
            parts.append(bare)
    if not parts and not short and line:
        parts = [line]
    return (sorted(parts, key=lambda p: (-len(p), p)), line, short) if parts else None


def _near_line(word: str) -> str:
    return next((line for line in LINES if len(line) >= 5 and edits(word, line, 1) <= 1), "")


def orders(parts: list[str]) -> list[str]:
    """The name as one string: longest part first, and for two parts the other order too, as joined spellings have it."""
    whole = "".join(parts)
    return [whole, parts[1] + parts[0]] if len(parts) == 2 else [whole]


def near_strings(a: str, b: str) -> bool:
    return edits(a, b, 2 if min(len(a), len(b)) >= 12 else 1) <= (2 if min(len(a), len(b)) >= 12 else 1)


def parse_person(text: str) -> list[str]:
    """The parts of a person's name, without titles, degrees and what else was written beside it."""
    t = re.split(r"[\n\r(|;/]|\s[-–—]\s|:", text.strip())[0]
    pieces = [p for p in t.split(",") if p.strip()]
    kept: list[str] = []
    for n, p in enumerate(pieces):
        if re.search(r"[\d@]", p):
            break
        words = [w for w in re.findall(r"[^\W\d_]+", fold(p)) if w not in BESIDE]
        if n and len([w for w in kept if len(w) > 1]) >= 2 and not re.search(r"-", pieces[0]):
            break
        kept += words
    if len(kept) == 1 and (m := re.match(r"\s*([A-Z][^\W\d_A-Z]+)([A-Z][^\W\d_]+)", pieces[0] if pieces else "")):
        kept = [fold(m[1]), fold(m[2])]
    return kept


def same_part(a: str, b: str) -> float:
    """How surely two name parts are one: equal 1, an edit apart 0.95, a known short form 0.9, mistyped ones 0.85, an initial 0.5.

    An initial stands for every form of a given name.
    """
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if short == 1:
        initial, other = (a, b) if len(a) == 1 else (b, a)
        return 0.5 if initial == other[0] or initial in _INITIALS.get(_GIVEN.get(other, -1), ()) else 0.0
    if a in _GIVEN and b in _GIVEN:
        return 0.9 if _GIVEN[a] == _GIVEN[b] else 0.0
    if short >= 4 and edits(a, b, 1) == 1:
        return 0.95
    if short >= TWO_EDITS and edits(a, b, 2) == 2:
        return 0.85
    if given_groups(a) & given_groups(b):
        return 0.85
    if short >= 2 and edits(a, b, 1) == 1:
        return 0.6
    if short >= 3 and (a.startswith(b) or b.startswith(a)) and abs(len(a) - len(b)) >= 2:
        return 0.6
    return 0.0


def same_name(a: list[str], b: list[str]) -> bool:
    """Whether two names align: every part of the shorter has its own part in the longer, one of them in full.

    The assignment is optimal. Parts of the longer without a partner may be initials; a full one may remain only if two
    others agree in full.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return False
    if near_joined(a, b):
        return True
    worth = []
    for x in a:
        worth.append([same_part(x, y) for y in b])
        if not any(worth[-1]):
            return False
    chosen = assign(worth)
    each = [row[j] for row, j in zip(worth, chosen)]
    full = sum(s >= 0.85 for s in each)
    if not all(each) or not full or len(a) == 1 and len(b) > 1:
        return False
    left = [w for j, w in enumerate(b) if j not in set(chosen)]
    return all(len(w) == 1 for w in left) or full >= 2


def near_joined(a: list[str], b: list[str]) -> bool:
    """Whether two names of different numbers of parts are the same letters run together, in any order, up to one edit."""
    if len(a) == len(b):
        return False
    a, b = [w for w in a if len(w) > 1], [w for w in b if len(w) > 1]
    if min(len("".join(a)), len("".join(b))) < 8:
        return False
    extra, lacking = Counter("".join(a)), Counter("".join(b))
    extra, lacking = extra - lacking, lacking - extra
    if extra.total() > 1 or lacking.total() > 1:
        return False
    # Within an edit of each other, the two share a form that lacks one letter.
    without = lambda parts: [parts, *[[*parts[:i], w[:k] + w[k + 1 :], *parts[i + 1 :]] for i, w in enumerate(parts) for k in range(len(w))]]
    spelled: dict[str, list] = {}
    for x in without(a):
        spelled.setdefault("".join(sorted("".join(x))), []).append(x)
    return any(_tiles(x, y) for y in without(b) for x in spelled.get("".join(sorted("".join(y))), ()))


def _tiles(a: list[str], b: list[str]) -> bool:
    """Whether the parts of a and those of b, each in some order, run together to one text."""
    seen = set()

    def go(x: tuple[str, ...], y: tuple[str, ...], ahead: str) -> bool:
        """ahead is what the parts taken for y have over those taken for x."""
        if not x and not y and not ahead:
            return True
        if (x, y, ahead) in seen:
            return False
        seen.add((x, y, ahead))
        if not ahead:
            return bool(x and y) and any(go(x, y[:j] + y[j + 1 :], y[j]) for j in range(len(y)))
        for i, w in enumerate(x):
            rest = x[:i] + x[i + 1 :]
            if ahead.startswith(w) and go(rest, y, ahead[len(w) :]) or w.startswith(ahead) and w != ahead and go(y, rest, w[len(ahead) :]):
                return True
        return False

    return go(tuple(sorted(w for w in a if w)), tuple(sorted(w for w in b if w)), "")


#: Members of a group that are held against the whole group in one task.
BUCKET = 256


def group_pairs(df: DataFrame, group: str, member: str, *carry: str) -> DataFrame:
    """(a, b) with a < b of the members of each group, with ``carry`` of both as a_ and b_; the groups are cut into buckets."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_buckets", F.ceil(F.col("_n") / BUCKET).cast("int")).drop("_n")
    rows = df.join(sizes, group)
    side = lambda s: [F.col(member).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in carry]]
    left = rows.select(group, F.pmod(F.xxhash64(member), F.col("_buckets").cast("long")).cast("int").alias("_bucket"), *side("a"))
    right = rows.select(group, F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)).alias("_bucket"), *side("b"))
    return left.join(right, [group, "_bucket"]).where("a < b").drop("_bucket")


def link_firms(texts: DataFrame) -> DataFrame:
    """text, firm: the spelling each distinct text stands for, as a key; texts without a name, or with one that fits several lines, have none.

    Names without a listed line of business that no firm with a line is near are linked among themselves and have a key
    with an empty line; of these, names under 5 letters stand for each other only where they are equal. ``texts`` has the columns text and n (rows). Null and blank texts are left out.
    """
    spark = texts.sparkSession
    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, n, *p) for t, n in zip(b["text"], b["n"]) if (p := parse_firm(t))]
            yield pd.DataFrame(rows, columns=["text", "n", "parts", "line", "short"])

    parsed = cut(spread_small(texts.where("text is not null")).mapInPandas(parse, "text string, n long, parts array<string>, line string, short string"))
    names = parsed.where("short = ''").groupBy("parts", "line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [("".join(p), line, n, list(p), v) for p, line, n in zip(b["parts"], b["line"], b["n"]) for v in {d for o in orders(list(p)) for d in deletions(o)}]
            yield pd.DataFrame(rows, columns=["name", "line", "n", "parts", "gone"])

    # Names in full outweigh joined ones, which could not tell their parts.
    weighed = names.withColumn("n", F.col("n") + F.when(F.size("parts") > 1, F.lit(1 << 40)).otherwise(F.lit(0)))
    spelled = cut(spread_small(weighed).mapInPandas(spell, "name string, line string, n long, parts array<string>, gone string"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [a == t or (line != "" or min(len(a), len(t)) >= 5) and any(near_strings(o, u) for o in orders(list(p)) for u in orders(list(q))) for a, t, line, p, q in zip(b["name"], b["top"], b["line"], b["parts"], b["top_parts"])]
            yield b[ok][["name", "line", "top", "top_n"]]

    def best_of(pairs: DataFrame) -> DataFrame:
        near = pairs.select("name", "line", "parts", F.col("top.name").alias("top"), F.col("top.n").alias("top_n"), F.col("top.parts").alias("top_parts")).distinct()
        near = near.mapInPandas(check, "name string, line string, top string, top_n long")
        return near.groupBy("name", "line").agg(F.max(F.struct("top_n", "top")).alias("x")).select("name", "line", F.col("x.top").alias("top"))

    def firms_of(spelled: DataFrame) -> DataFrame:
        tops = spelled.groupBy("line", "gone").agg(F.max(F.struct("n", "name", "parts")).alias("top"))
        parent = cut(best_of(spelled.join(tops, ["line", "gone"])))
        second = parent.select(F.col("name").alias("top"), "line", F.col("top").alias("further"))
        return parent.join(second, ["top", "line"], "left").select("name", "line", F.concat_ws("|", F.coalesce("further", "top"), "line").alias("firm"))

    parent = firms_of(spelled.where("line != ''"))
    full = parsed.where("short = '' and line != ''").withColumn("name", F.concat_ws("", "parts")).join(parent, ["name", "line"]).select("text", "firm")
    # Names without a line of business belong to the one firm of that name, if there is one only.
    by_gone = spelled.where("line != ''").join(parent, ["name", "line"]).groupBy("gone").agg(F.min("firm").alias("lo"), F.max("firm").alias("hi"))
    near = cut(spelled.where("line = ''").join(by_gone, "gone").groupBy("name").agg(F.min("lo").alias("firm"), F.max("hi").alias("hi")))
    alone = firms_of(spelled.where("line = ''").join(near.select("name"), "name", "left_anti"))
    bare = near.where("firm = hi").select("name", "firm").unionByName(alone.select("name", "firm"))
    bare = parsed.where("short = '' and line = ''").withColumn("name", F.concat_ws("", "parts")).join(bare, "name").select("text", "firm")
    # A part cut short is completed by the firm that has the other parts and the line.
    known = names.where("line != ''").withColumn("name", F.concat_ws("", "parts")).join(parent, ["name", "line"])
    known = known.select("line", "firm", "parts", F.explode("parts").alias("part")).distinct()
    cutoff = parsed.where("short != '' and size(parts) >= 1").select("text", "line", "short", F.element_at("parts", 1).alias("part"))
    cutoff = cutoff.join(known.withColumnRenamed("line", "known_line"), "part").where("(line = known_line or line = '') and exists(parts, p -> p != part and startswith(p, short))")
    cutoff = cutoff.groupBy("text").agg(F.min("firm").alias("firm"), F.max("firm").alias("hi")).where("firm = hi").select("text", "firm")
    return full.unionByName(bare).unionByName(cutoff)


def employer_rows(resumes: DataFrame) -> DataFrame:
    """candidate_id, text of every job's company."""
    jobs = resumes.select("candidate_id", F.explode(F.transform("experience", lambda x: x["company"])).alias("text"))
    return jobs.where("length(trim(text)) > 0").distinct()


def like_records(resumes: DataFrame, firms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parts, school, fields, firms) of the groups of records that agree in all of them, and (id, member) of their candidate_ids.

    A record counts if it has a name, an education with an institution and an employer; others are no case. A group is
    known by a digest of what its records agree in, so that none is gathered to be named.
    """
    ship(resumes.sparkSession)
    works = employer_rows(resumes).join(firms, "text", "left").select("candidate_id", F.xxhash64(F.coalesce("firm", F.lower("text"))).alias("firm")).distinct()
    works = works.groupBy("candidate_id").agg(F.array_sort(F.collect_set("firm")).alias("firms"))
    taught = F.filter("education", lambda x: F.length(F.trim(x["institution"])) > 0)
    said = lambda x, f: F.lower(F.trim(F.coalesce(x[f], F.lit(""))))
    taught = F.array_sort(F.transform(taught, lambda x: F.struct(said(x, "institution").alias("i"), said(x, "degree_level").alias("d"), said(x, "field").alias("f"))))
    people = resumes.where("length(trim(candidate_name)) > 0").select("candidate_id", F.col("candidate_name").alias("name"), taught.alias("taught")).distinct().where("size(taught) > 0")
    people = people.select("candidate_id", "name", F.xxhash64(F.transform("taught", lambda x: F.struct(x["i"], x["d"]))).alias("school"), F.transform("taught", lambda x: x["f"]).alias("fields"))
    people = people.join(works, "candidate_id")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["parts"] = [parse_person(n) for n in b["name"]]
            yield b[[len(p) > 0 for p in b["parts"]]][["candidate_id", "parts", "school", "fields", "firms"]]

    schema = "candidate_id string, parts array<string>, school long, fields array<string>, firms array<long>"
    people = people.mapInPandas(parse, schema)
    people = cut(people.withColumn("id", F.unhex(F.md5(F.to_json(F.struct("parts", "school", "fields", "firms"))))))
    like = people.groupBy("id").agg(*[F.first(c).alias(c) for c in ("parts", "school", "fields", "firms")])
    return cut(like), people.select("id", F.col("candidate_id").alias("member")).distinct()


def compare(like: DataFrame) -> DataFrame:
    """a, b: representatives whose names align, whose fields of study do not disagree and who share an employer.

    The key of the index is school, employer and a deletion of a name part, so that only records that agree in the first
    two ever meet; what is alone with its school and employer is not indexed at all.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gone = []
            for parts in b["parts"]:
                long = [p for p in parts if len(p) > 1]
                # Names may agree in full by any part, be it a given name or an initial.
                joined = "".join(long)
                keys = {k for p in parts for k in part_keys(p)} | {f"#{g}" for p in parts for g in given_groups(p)} | ({joined, "".join(reversed(long))} if len(long) > 1 else set())
                gone.append(sorted(keys))
            yield pd.DataFrame({"id": b["id"], "school": b["school"], "firms": b["firms"], "gone": gone})

    meet = like.select("id", "school", F.explode("firms").alias("firm"))
    crowded = meet.groupBy("school", "firm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = meet.join(crowded, ["school", "firm"], "left_semi").groupBy("id").agg(F.collect_set("firm").alias("firms"))
    keys = like.select("id", "parts", "school").join(crowded, "id").mapInPandas(index, "id binary, school long, firms array<long>, gone array<string>")
    keys = keys.select("id", "school", "gone", F.explode("firms").alias("firm")).select("id", "school", "firm", F.explode("gone").alias("gone"))
    keys = keys.select("id", F.xxhash64("school", "firm", "gone").alias("key"))
    near = group_pairs(keys, "key", "id").select("a", "b").distinct()
    a = like.select(F.col("id").alias("a"), F.col("parts").alias("a_parts"), F.col("fields").alias("a_fields"), F.col("school").alias("a_school"), F.col("firms").alias("a_firms"))
    b = like.select(F.col("id").alias("b"), F.col("parts").alias("b_parts"), F.col("fields").alias("b_fields"), F.col("school").alias("b_school"), F.col("firms").alias("b_firms"))
    both = near.join(a, "a").join(b, "b").where((F.col("a_school") == F.col("b_school")) & F.arrays_overlap("a_firms", "b_firms"))
    agree = F.forall(F.zip_with("a_fields", "b_fields", lambda x, y: (x == y) | (x == "") | (y == "")), lambda x: x)
    both = both.where(agree).select("a", "b", "a_parts", "b_parts")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[[same_name(list(x), list(y)) for x, y in zip(p["a_parts"], p["b_parts"])]][["a", "b"]]

    return both.mapInPandas(align, "a binary, b binary")


def link_persons(resumes: DataFrame, firms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the classes of like records that are one person's, and (id, member) of their candidate_ids.

    This is the whole result: members of a class are all linked to each other, and to all members of the classes theirs
    is linked to. Links are not closed over chains: of three spellings the outer two may be too far apart.
    """
    like, members = like_records(resumes, firms)
    return cut(compare(like)), members


def person_classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """candidate_id, class_id, n_links: every record with its class, and how many other records it is linked to."""
    sizes = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    sides = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    beyond = sides.join(sizes.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("n").alias("beyond"))
    counts = sizes.join(beyond, "id", "left").select("id", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    return members.join(counts, "id").select(F.col("member").alias("candidate_id"), F.lower(F.hex("id")).alias("class_id"), "n_links")


def person_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """key_a, key_b of all candidate_ids of one person, for where a pair for each is asked for; link_persons tells the same in less."""
    left = links.join(members.select(F.col("id").alias("a"), F.col("member").alias("x")), "a")
    across = left.join(members.select(F.col("id").alias("b"), F.col("member").alias("y")), "b").select("x", "y")
    within = group_pairs(members, "id", "member").select(F.col("a").alias("x"), F.col("b").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def firm_table(resumes: DataFrame) -> DataFrame:
    """text, firm of the companies in resumes.experience."""
    texts = resumes.select(F.explode(F.transform("experience", lambda x: x["company"])).alias("text")).where("length(trim(text)) > 0").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return cut(link_firms(texts))


def persons(resumes: DataFrame) -> DataFrame:
    """candidate_id, class_id, n_links of every record with a name, an education with an institution and an employer.

    Records of a class agree in name parts, education and employers; n_links counts the other records of the person.
    Nulls, empty tables, long texts and repeated rows as in found.
    """
    return person_classes(*link_persons(resumes, small(firm_table(resumes))))


def found(resumes: DataFrame) -> DataFrame:
    """kind (person, company), key_a, key_b: pairs of records of one person and of texts of one firm.

    Records with a null or blank name, without an employer or without an institution are no case, and neither are null and
    blank companies; texts of any length are compared whole. A firm with a part cut short, or without a line of business
    but near to one with a line, is linked only where one firm alone fits. Each pair comes once, repeated rows count once. Other columns are not read.
    An empty table gives an empty result.
    """
    firms = firm_table(resumes)
    companies = group_pairs(firms, "firm", "text").select(F.lit("company").alias("kind"), F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    persons = person_pairs(*link_persons(resumes, small(firms)))
    return companies.distinct().unionByName(persons.select(F.lit("person").alias("kind"), "key_a", "key_b"))
