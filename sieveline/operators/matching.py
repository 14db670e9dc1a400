"""Matching of requirements with skills and evidence. What a text is worth for a requirement is told by a judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import or_empty
from ..functions.text import contains_word, norm, word_set
from ..session import cut, ship
from .percandidate import EQUAL_SKILLS, ExactSkills, Worths, gathered, passed, passed_roles
from .retrieval import bm25_top, evidence_chunks, plain_chunks

# What a level of match contributes, and the least contribution that clears the gate.
LEVELS = {"direct": 1.0, "related": 0.7, "weak": 0.35, "none": 0.0}
GATE = 0.8

#: A judge takes (requirement, evidence: array<string>) rows and returns them with level and reason.
Judge = Callable[[DataFrame], DataFrame]


def normed(skills: Column) -> Column:
    """Skills that are not blank, as s and, normed, n; many tells whether it has two words or more."""
    kept = F.transform(or_empty(skills), lambda s: F.struct(s.alias("s"), norm(s).alias("n")))
    return F.transform(F.filter(kept, lambda x: F.length(x["n"]) > 0), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), (F.size(F.split(x["n"], r"\s+")) > 1).alias("many")))


def exact_normed(requirement: Column, skills: Column) -> Column:
    """exact_skill over normed skills, which can so be made once for each candidate."""
    req = norm(requirement)
    variants = F.array(req)
    for a, b in EQUAL_SKILLS:
        variants = F.when(req == a, F.array(req, F.lit(b))).when(req == b, F.array(req, F.lit(a))).otherwise(variants)
    same = F.filter(skills, lambda x: F.array_contains(variants, x["n"]))
    holds = F.filter(skills, lambda x: F.exists(variants, lambda v: contains_word(x["n"], v)) | (x["many"] & contains_word(req, x["n"])))
    first = lambda c: F.try_element_at(c, F.lit(1))["s"]
    return F.when(F.length(req) > 0, F.coalesce(first(same), first(holds)))


def exact_skill(requirement: Column, skills: Column) -> Column:
    """The first skill equal or equivalent to the requirement; else the first that holds it, or of two words or more lies in it; else null."""
    return exact_normed(requirement, normed(skills))


def exact_matches(asked: DataFrame, skills: DataFrame) -> DataFrame:
    """candidate_id, requirement of asked with matched: the skill exact_skill finds among skills (candidate_id, skills), or null.

    skills has a row for each candidate at most.
    """
    return exact_by_candidate(gathered(asked), skills, "left")


def exact_by_candidate(asked: DataFrame, skills: DataFrame, how: str = "inner") -> DataFrame:
    """exact_matches of rows that hold a candidate each: asked (candidate_id, requirements)."""
    return passed(asked.join(skills.select("candidate_id", "skills"), "candidate_id", how), ExactSkills())


def contribution(level: Column) -> Column:
    out = F.lit(0.0)
    for name, worth in LEVELS.items():
        out = F.when(level == name, F.lit(worth)).otherwise(out)
    return out


def evidence_status(worth: Column) -> Column:
    return F.when(worth <= 0, "missing").when(worth < GATE, "weak_match").otherwise("matched")


# Words of a requirement that the lexical judge does not count.
UNTOLD = ("of", "and", "the", "in", "for", "with")


def lexical_judge(asked: DataFrame) -> DataFrame:
    """A deterministic stand-in for a language model: the share of the requirement's words in the evidence tells the level.

    It is not equivalent to any model's judgement and is there so that pipelines run without one.
    """
    req = word_set(F.col("requirement"), UNTOLD)
    share = F.size(F.array_intersect(req, F.array_distinct(F.flatten(F.transform("evidence", lambda e: word_set(e)))))) / F.nullif(F.size(req), F.lit(0))
    share_ = F.col("_share")
    level = F.when(share_ >= 1, "direct").when(share_ >= 0.6, "related").when(share_ > 0.3, "weak").otherwise("none")
    return asked.withColumn("_share", share).withColumns({"level": level, "reason": F.concat(F.lit("share of words "), F.format_number(share_, 2))}).drop("_share")


def lexical_level(asked: frozenset[str], held: set[str]) -> tuple[str, float]:
    """The level that lexical_judge gives and the share it tells, of the words of a requirement and of its evidence."""
    told = asked.difference(UNTOLD)
    if not told:
        return "none", 0.0
    share = len(told & held) / len(told)
    return "direct" if share >= 1 else "related" if share >= 0.6 else "weak" if share > 0.3 else "none", share


def lexical_reason(share: float) -> str:
    return f"share of words {share:.2f}"


#: Says that a judge is expressions on its rows, which cost less than telling the rows apart.
lexical_judge.is_expression = True
#: The same of sets of words, for judges that need no more; such a judge goes with each candidate's row.
lexical_judge.of_words, lexical_judge.reason_of = lexical_level, lexical_reason


def judged_once(asked: DataFrame, judge: Judge) -> DataFrame:
    """asked (requirement, evidence, ...) with level and reason: each distinct question is put once, unless the judge is an expression."""
    if getattr(judge, "is_expression", False):
        return judge(asked)
    return asked.join(judge(asked.select("requirement", "evidence").distinct()).select("requirement", "evidence", "level", "reason"), ["requirement", "evidence"])


def table_judge(judgements: DataFrame) -> Judge:
    """A judge that looks levels up by requirement and evidence hash; what it does not know is none."""

    def judge(asked: DataFrame) -> DataFrame:
        keyed = asked.withColumn("evidence_hash", F.xxhash64("evidence"))
        out = keyed.join(judgements.select("requirement", "evidence_hash", "level", "reason"), ["requirement", "evidence_hash"], "left")
        return out.withColumn("level", F.coalesce("level", F.lit("none"))).drop("evidence_hash")

    return judge


def asked_judge(ask: Callable[[str, list[str]], dict], evidence: str = "evidence") -> Judge:
    """A judge that puts each distinct question to ``ask`` (requirement, evidence -> match, confidence, reason) once.

    ``ask`` runs on the executors, so it must pickle; it is where a model's client goes. An answer that raises, or has no
    known match, counts as none, and no evidence is none without asking.
    """

    def judge(asked: DataFrame) -> DataFrame:
        ship(asked.sparkSession)

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for requirement, shown in zip(b["requirement"], b[evidence]):
                    try:
                        said = ask(requirement, list(shown)) if len(shown) else {"match": "none", "confidence": 1.0, "reason": "no evidence"}
                        rows.append((str(said.get("match", "")).strip().lower(), float(said.get("confidence", 0.0)), str(said.get("reason", ""))))
                    except Exception as error:  # one answer must not end the job
                        rows.append(("none", 0.0, f"no answer: {error}"))
                b["level"], b["confidence"], b["reason"] = ([r[n] for r in rows] for n in range(3))
                yield b[["requirement", evidence, "level", "confidence", "reason"]]

        told = asked.select("requirement", evidence).distinct().mapInPandas(put, f"requirement string, {evidence} array<string>, level string, confidence double, reason string")
        clean = told.withColumn("_clean", clean_judgement(F.col("level"), F.col("confidence")))
        return clean.withColumns({"level": F.col("_clean.match"), "confidence": F.col("_clean.confidence")}).drop("_clean")

    return judge


def judge_prompt(requirement: Column, evidence: Column) -> Column:
    """The text a model is asked with: the requirement and the labelled chunks, with a blank line between."""
    shown = F.transform(evidence, lambda e: F.concat(F.lit("["), e["source_label"], F.lit("] "), e["text"]))
    return F.concat(F.lit("Requirement: "), requirement, F.lit("\n\n"), F.array_join(shown, "\n\n"))


def clean_judgement(level: Column, confidence: Column) -> Column:
    """A model's answer made safe: an unknown level is none, a confidence lies between 0 and 1 and is 0 for no answer."""
    known = F.when(level.isin(*LEVELS), level).otherwise(F.lit("none"))
    return F.struct(known.alias("match"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))).alias("confidence"))


def score_skills(pairs: DataFrame, resumes: DataFrame, judge: Judge = lexical_judge, exact_only: bool = False, top_k: int = 3, skills_column: str = "skills") -> DataFrame:
    """pairs (candidate_id, role_id, category, pos, requirement) with matched_against, match_type, level, worth, reason, evidence, clears_gate, status.

    Exact matches are worth 1 and never reach the judge; the others are judged once for each distinct requirement and
    evidence, and those without evidence are none without asking. With exact_only the judged ones are worth nothing.
    """
    skills = resumes.dropDuplicates(["candidate_id"]).select("candidate_id", F.col(skills_column).alias("skills"))
    asked = exact_matches(pairs.select("candidate_id", "requirement").distinct(), skills).withColumnRenamed("matched", "matched_against")  # roles of a candidate share requirements
    looked = cut(pairs.join(asked, ["candidate_id", "requirement"], "left"))  # four branches go on from here
    exact = looked.where("matched_against is not null").withColumns({"match_type": F.lit("exact"), "level": F.lit("direct"), "worth": F.lit(1.0), "reason": F.lit(""), "evidence": F.array().cast("array<string>")})
    open_ = looked.where("matched_against is null").drop("matched_against")
    wanted = open_.select("candidate_id", "requirement").distinct()
    chunks = evidence_chunks(resumes.join(wanted.select("candidate_id").distinct(), "candidate_id", "left_semi").dropDuplicates(["candidate_id"]))
    best = bm25_top(chunks, wanted, top_k).join(chunks, ["candidate_id", "chunk_no"])
    shown = best.groupBy("candidate_id", "requirement").agg(F.array_sort(F.collect_list(F.struct("rnk", "text", "source_label"))).alias("c"))
    shown = shown.select("candidate_id", "requirement", F.transform("c", lambda c: c["text"]).alias("evidence"), F.try_element_at("c", F.lit(1))["source_label"].alias("label"))
    shown = cut(shown)
    judged = judged_once(shown, judge).select("candidate_id", "requirement", "label", "level", "reason", "evidence")
    rest = open_.join(judged, ["candidate_id", "requirement"], "left").withColumn("level", F.coalesce("level", F.lit("none")))
    worth = F.lit(0.0) if exact_only else contribution(F.col("level"))
    rest = rest.withColumns({"worth": worth, "matched_against": F.when(F.col("level") != "none", F.col("label")), "match_type": F.when(F.col("level") != "none", "evidence").otherwise("none")}).drop("label")
    both = exact.unionByName(rest.withColumns({"reason": F.coalesce("reason", F.lit("")), "evidence": F.coalesce("evidence", F.array().cast("array<string>"))}))
    return both.withColumns({"clears_gate": F.col("worth") >= GATE, "status": evidence_status(F.col("worth"))})


def score_list(results: DataFrame, *by: str) -> DataFrame:
    """``by``, average, matched, missing, gate_missing of scored requirements, in their order, which is also that of the sum."""
    some = lambda cond: F.transform(F.filter("rows", cond), lambda r: r["requirement"])
    rows = results.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "requirement", "worth", "clears_gate"))).alias("rows"))
    average = F.aggregate("rows", F.lit(0.0), lambda total, r: total + r["worth"]) / F.size("rows")
    return rows.select(*by, average.alias("average"), some(lambda r: r["worth"] > 0).alias("matched"), some(lambda r: r["worth"] == 0).alias("missing"), some(lambda r: ~r["clears_gate"]).alias("gate_missing"))


def list_scores(pairs: DataFrame, lists: DataFrame, resumes: DataFrame, judge: Judge = lexical_judge) -> DataFrame:
    """candidate_id, role_id, average, matched, missing, gate_missing of pairs (candidate_id, role_id) by the requirements, an array, of lists (role_id, requirements).

    The same as score_list of score_skills; roles that ask for nothing have no row. A judge of words goes with each
    candidate's row, others are asked through score_skills. resumes and lists have a row for each.
    """
    if not hasattr(judge, "of_words"):
        each = lists.select("role_id", F.posexplode("requirements").alias("pos", "requirement")).where("requirement is not null").withColumn("category", F.lit(""))
        asked = pairs.select("candidate_id", "role_id").distinct().join(resumes.select("candidate_id"), "candidate_id", "left_semi").join(each, "role_id")
        return score_list(score_skills(asked, resumes, judge), "candidate_id", "role_id")
    names = ("matched", "missing", "gate_missing")
    kernel = Worths(("requirements",), {"requirements": names}, judge.of_words, LEVELS, GATE)
    out = passed_roles(pairs, lists.select("role_id", "requirements"), resumes.select("candidate_id", "skills", plain_chunks()), kernel).where("requirements is not null")
    return out.select("candidate_id", "role_id", F.col("requirements").alias("average"), *[F.col(f"requirements_{n}").alias(n) for n in names])
