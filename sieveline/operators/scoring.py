"""Scores of candidates for roles: weighted categories, a gate on missing requirements, and views of the result.

Weights, gate and tiers are parameters; the values given here are those of the usual configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import or_empty, titles
from ..functions.text import degree_tier, field_overlap, norm, round_half_even, strip, text_or_empty
from ..schemas import CATEGORIES
from ..session import cut
from .matching import GATE, LEVELS, Judge, lexical_judge, score_list, score_skills
from .percandidate import Fits, passed_roles
from .ranks import placed
from .retrieval import plain_chunks
from .titles import BYPASS, title_match

# Share of each category, most missing requirements that pass the gate, tiers of three views.
WEIGHTS = {"mandatory_skills": 0.25, "relevant_experience": 0.25, "job_title_match": 0.05, "industry_keywords": 0.10, "soft_skills": 0.10, "education": 0.20, "preferred_skills": 0.05}
GATE_MISSING = 6
TIERS = ((87, "excellent"), (82, "strong"), (72, "review"))
EXCELLENT, STRONG, COMPARED = 85, 80, 75
SKILL_LISTS = {"mandatory_skills": "mandatory_skills", "preferred_skills": "preferred_technical_skills", "soft_skills": "soft_preferred_skills", "industry_keywords": "industry_keywords"}


def experience_score(total: Column, least: Column, weight: float = WEIGHTS["relevant_experience"]) -> Column:
    """All or nothing; everything if nothing is asked for."""
    return F.when(least.isNull() | (F.coalesce(total, F.lit(0.0)) >= least), F.lit(weight * 100)).otherwise(F.lit(0.0))


def degree_met(requirement: Column, education: Column) -> Column:
    """Whether a requirement's level and field are met; higher degrees also stand for a bachelor's, and other levels for any."""
    tiers = F.transform(F.coalesce(education, F.array().cast("array<struct<degree_level:string,field:string,institution:string>>")), lambda e: degree_tier(e["degree_level"]))
    tier = degree_tier(requirement["degree_level"])
    higher = (tier == "bachelor") & (F.array_contains(tiers, "master") | F.array_contains(tiers, "phd"))
    return ((tier == "other") | F.array_contains(tiers, tier) | higher) & field_overlap(requirement["field"], education)


def education_score(requirements: Column, education: Column, weight: float = WEIGHTS["education"]) -> Column:
    """Everything if none or any of the requirements is met, else nothing."""
    none = F.size(F.coalesce(requirements, F.array())) == 0
    return F.when(none | F.exists(requirements, lambda r: degree_met(r, education)), F.lit(weight * 100)).otherwise(F.lit(0.0))


def tier(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def final_score(categories: Column) -> Column:
    total = F.lit(0.0)
    for c in CATEGORIES:
        total = total + F.coalesce(categories[c], F.lit(0.0))
    return round_half_even(total, 2)


def viewed(resumes: DataFrame, jds: DataFrame, persisted_view: bool) -> tuple[DataFrame, Column, str]:
    """jds with industry_keywords, the title of the summary, and the column of skills, as fit_parts says."""
    keywords = or_empty(F.col("industry_keywords")) if "industry_keywords" in jds.columns and not persisted_view else F.array().cast("array<string>")
    summary = F.col("current_role_title_from_summary") if "current_role_title_from_summary" in resumes.columns and not persisted_view else F.lit(None).cast("string")
    return jds.withColumn("industry_keywords", keywords), summary, "skills_all_sources" if "skills_all_sources" in resumes.columns else "skills"


def fit_parts(pairs: DataFrame, resumes: DataFrame, jds: DataFrame, judge: Judge = lexical_judge, persisted_view: bool = True) -> dict[str, DataFrame]:
    """What job_fit and fit_evidence are made of: the pairs, their scored requirements, their titles, and both records.

    Industry keywords are those of jds if it has the column and persisted_view is off; skills are skills_all_sources
    if resumes has that column, else skills.
    """
    pairs = cut(pairs.select("candidate_id", "role_id").distinct())
    jds, summary, skills = viewed(resumes, jds, persisted_view)

    def named(category: str, column: str) -> Column:
        return F.transform(or_empty(F.col(column)), lambda r, i: F.struct(F.lit(category).alias("category"), i.alias("pos"), r.alias("requirement")))

    listed = F.concat(*[named(*x) for x in SKILL_LISTS.items()])
    asked = pairs.join(jds.select("role_id", F.explode(listed).alias("x")), "role_id").select("candidate_id", "role_id", "x.*").where("requirement is not null")
    scored = score_skills(asked, resumes, judge, skills_column=skills)
    # Only the titles of the jobs go on with the pairs.
    heads = F.transform("experience", lambda e: F.struct(e["title"].alias("title"), e["company"].alias("company")))
    people = resumes.select("candidate_id", heads.alias("experience"), "education", "total_years_experience", summary.alias("summary_title"), F.col(skills).alias("skills"))
    roles = jds.select("role_id", "role_title", "min_years_experience", "education_requirements", F.size(or_empty(F.col("mandatory_skills"))).alias("asked"))
    named_titles = pairs.join(people.select("candidate_id", "summary_title", "experience"), "candidate_id").join(roles.select("role_id", "role_title"), "role_id")
    return {"pairs": pairs, "scored": scored, "titles": title_match(named_titles, judge), "people": people, "roles": roles}


def fit_scores(parts: dict[str, DataFrame]) -> DataFrame:
    """candidate_id, role_id, category_scores, final_score, hard_gate_failed, hard_gate_reason, gate_missing of fit_parts."""
    lists = score_list(parts["scored"], "candidate_id", "role_id", "category")
    wide = lists.groupBy("candidate_id", "role_id").agg(
        *[F.max(F.when(F.col("category") == c, F.col("average"))).alias(c) for c in SKILL_LISTS], F.max(F.when(F.col("category") == "mandatory_skills", F.struct("gate_missing"))).alias("m")
    )
    full = parts["pairs"].join(parts["people"].drop("experience", "skills"), "candidate_id").join(parts["roles"], "role_id")
    worth = parts["titles"].select("candidate_id", "role_id", F.col("worth").alias("title_worth"))
    full = full.join(worth, ["candidate_id", "role_id"]).join(wide, ["candidate_id", "role_id"], "left").withColumn("mandatory_skills_gate_missing", F.col("m.gate_missing"))
    blank = F.length(strip(text_or_empty(F.col("role_title")))) == 0
    return summed(full.withColumn("blank", blank), education_score(F.col("education_requirements"), F.col("education")))


def summed(full: DataFrame, education: Column) -> DataFrame:
    """fit_scores of pairs with the averages of their lists, title_worth, years, and what their education earns."""
    part = {c: round_half_even(F.coalesce(F.col(c), F.lit(1.0)) * WEIGHTS[c] * 100, 2) for c in SKILL_LISTS}
    part["relevant_experience"] = experience_score(F.col("total_years_experience"), F.col("min_years_experience"))
    part["education"] = education
    part["job_title_match"] = round_half_even(F.when(F.col("blank"), 1.0).otherwise(F.col("title_worth")) * WEIGHTS["job_title_match"] * 100, 2)
    scores = F.struct(*[part[c].alias(c) for c in CATEGORIES])
    missing = or_empty(F.col("mandatory_skills_gate_missing"))
    failed = F.size(missing) > GATE_MISSING
    reason = F.when(failed, F.concat(F.size(missing).cast("string"), F.lit(" of "), F.col("asked").cast("string"), F.lit(" mandatory skills missing or not confidently evidenced: "), F.array_join(missing, ", "))).otherwise("")
    out = full.select("candidate_id", "role_id", scores.alias("category_scores"), missing.alias("gate_missing"), failed.alias("hard_gate_failed"), reason.alias("hard_gate_reason"))
    return out.withColumn("final_score", final_score(F.col("category_scores")))


def job_fit(pairs: DataFrame, resumes: DataFrame, jds: DataFrame, judge: Judge = lexical_judge, persisted_view: bool = True) -> DataFrame:
    """candidate_id, role_id, category_scores, final_score, hard_gate_failed, hard_gate_reason, gate_missing of each pair.

    ``pairs`` has candidate_id and role_id; resumes and jds have one row for each; the rest as in fit_parts. An empty list
    of requirements earns its whole category. A judge of words goes with each candidate's row, so that nothing of the size
    of pairs times requirements is stored.
    """
    if hasattr(judge, "of_words"):
        return fit_by_candidate(pairs, resumes, jds, judge, persisted_view)
    return fit_scores(fit_parts(pairs, resumes, jds, judge, persisted_view))


def fit_by_candidate(pairs: DataFrame, resumes: DataFrame, jds: DataFrame, judge: Judge, persisted_view: bool = True) -> DataFrame:
    """job_fit in one pass over rows that hold a candidate each."""
    jds, summary, skills = viewed(resumes, jds, persisted_view)
    lists = jds.select(
        "role_id", *[F.col(column).alias(c) for c, column in SKILL_LISTS.items()], strip(text_or_empty(F.col("role_title"))).alias("target"), F.size(or_empty(F.col("mandatory_skills"))).alias("asked"),
        F.col("min_years_experience").cast("double").alias("min_years_experience"), "education_requirements",
    )
    people = resumes.select("candidate_id", F.col(skills).alias("skills"), plain_chunks(), titles(summary, F.col("experience")).alias("titles"), "education", F.col("total_years_experience").cast("double").alias("total_years_experience"))
    kernel = Fits(tuple(SKILL_LISTS), {"mandatory_skills": ("gate_missing",)}, judge.of_words, LEVELS, GATE, reason=judge.reason_of, bypass=BYPASS)
    full = passed_roles(pairs, lists, people, kernel)
    return summed(full, F.when(F.col("education_met"), F.lit(WEIGHTS["education"] * 100)).otherwise(F.lit(0.0)))


def fit_evidence(parts: dict[str, DataFrame]) -> DataFrame:
    """candidate_id, role_id, evidence: why each pair of fit_parts scored as it did.

    evidence has a list of rows (skill, status, match_type, matched_against, contribution, evidence, judge_reason) for each
    category of skills, what title, years and degrees say, and the candidate's skills that no requirement used.
    """
    row = F.struct(
        "pos", F.struct(F.col("requirement").alias("skill"), "status", "match_type", "matched_against", F.col("worth").alias("contribution"), "evidence", F.col("reason").alias("judge_reason")).alias("row")
    )
    each = parts["scored"].groupBy("candidate_id", "role_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("category") == c, row))).alias(c) for c in SKILL_LISTS], F.collect_set(F.when(F.col("match_type") == "exact", norm(F.col("matched_against")))).alias("used")
    )
    titles = parts["titles"].select("candidate_id", "role_id", F.struct(F.col("best_title").alias("title"), F.col("level").alias("match_level"), "status", F.col("worth").alias("contribution"), "warning").alias("job_title"))
    full = parts["pairs"].join(parts["people"], "candidate_id").join(parts["roles"], "role_id").join(titles, ["candidate_id", "role_id"], "left").join(each, ["candidate_id", "role_id"], "left")
    total = F.coalesce("total_years_experience", F.lit(0.0))
    years = F.when(F.col("min_years_experience").isNotNull(), F.struct(total.alias("total_years_experience"), F.col("min_years_experience").alias("min_years_required"), F.when(total >= F.col("min_years_experience"), "matched").otherwise("missing").alias("status")))
    given = lambda c, other: F.when(F.length(text_or_empty(c)) > 0, c).otherwise(F.lit(other))
    degrees = F.transform("education_requirements", lambda r: F.struct(given(r["degree_level"], "Degree").alias("required_degree_level"), given(r["field"], "Any Field").alias("required_field"), F.when(degree_met(r, F.col("education")), "matched").otherwise("missing").alias("status")))
    rows = [F.coalesce(F.transform(c, lambda x: x["row"]), F.array().cast("array<struct<skill:string,status:string,match_type:string,matched_against:string,contribution:double,evidence:array<string>,judge_reason:string>>")).alias(c) for c in SKILL_LISTS]
    more = F.filter(or_empty(F.col("skills")), lambda s: ~F.array_contains(or_empty(F.col("used")), norm(s)))
    return full.select("candidate_id", "role_id", F.struct(*rows, "job_title", years.alias("experience"), degrees.alias("education"), more.alias("additional_candidate_skills")).alias("evidence"))


def rank_all(scores: DataFrame, by: str) -> DataFrame:
    """scores with rank (from 1) within ``by``, best first; of equal scores those that pass the gate come first, then by candidate_id."""
    order = [F.col("final_score").desc_nulls_last(), F.coalesce("hard_gate_failed", F.lit(False)).asc(), F.col("candidate_id").asc()]
    return placed(scores, by, order)


def summary_stats(scores: DataFrame, *by: str) -> DataFrame:
    """``by``, total, passed, excellent, strong, average (1 digit) of scores; strong includes excellent."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), n(~F.col("hard_gate_failed")).alias("passed"), n(F.col("final_score") >= EXCELLENT).alias("excellent"), n(F.col("final_score") >= STRONG).alias("strong"),
        F.round(F.avg("final_score"), 1).alias("average"),
    )


def filter_view(scores: DataFrame, view: str) -> DataFrame:
    """One of the views all, excellent, strong, mandatory."""
    wanted = {"all": F.lit(True), "excellent": F.col("final_score") >= EXCELLENT, "strong": F.col("final_score") >= STRONG, "mandatory": ~F.col("hard_gate_failed")}[view]
    return scores.where(wanted)


def comparison(scores: DataFrame, least: float = COMPARED) -> DataFrame:
    """candidate_id, role_id, run_id, field, value: the compared candidates' categories in long form, with their share of the most."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("category_scores")[c].alias("value"), F.lit(WEIGHTS[c] * 100).alias("most")) for c in CATEGORIES])).alias("x")
    out = scores.where(F.col("final_score") >= least).select("candidate_id", "role_id", "run_id", pairs).select("candidate_id", "role_id", "run_id", "x.*")
    return out.withColumn("percent", percent_of_most(F.col("value"), F.col("most"))).drop("most")


def percent_of_most(value: Column, most: Column) -> Column:
    return F.least(F.round(value / most * 100), F.lit(100.0)).cast("int")


def explain_rank(name: Column, role: Column, rank: Column, score: Column, failed: Column, reason: Column, missing: Column) -> Column:
    """Sentences that say why a candidate stands where they stand."""
    # The wording of the sentences.
    given = lambda c, other: F.when(F.length(c) > 0, c).otherwise(F.lit(other))
    first = F.concat(given(name, "This candidate"), F.lit(" ranks #"), rank.cast("string"), F.lit(" for "), given(role, "this role"), F.lit(" with a Job Fit score of "), score.cast("string"), F.lit("%."))
    lacks = F.concat(F.lit("Missing "), F.size(missing).cast("string"), F.lit(" mandatory skill(s): "), F.array_join(missing, ", "), F.lit("."))
    second = F.when(failed, given(reason, "Failed the mandatory-skills hard gate.")).when(F.size(or_empty(missing)) == 0, F.lit("All mandatory requirements are satisfied.")).otherwise(lacks)
    return F.filter(F.array(first, second), lambda x: x.isNotNull())


def recent_role(experience: Column) -> Column:
    return F.try_element_at(experience, F.lit(1))


def jd_summary(least: Column, requirements: Column) -> Column:
    """"N+ yrs experience · degree in field or degree in field"; what is not given is left out."""
    kept = lambda *xs: F.filter(F.array(*xs), lambda v: F.length(text_or_empty(v)) > 0)
    degrees = F.filter(F.transform(F.coalesce(requirements, F.array().cast("array<struct<degree_level:string,field:string,required:boolean>>")), lambda e: F.array_join(kept(e["degree_level"], e["field"]), " in ")), lambda s: F.length(s) > 0)
    number = F.when(least == F.floor(least), F.floor(least).cast("string")).otherwise(least.cast("string"))
    return F.array_join(kept(F.concat(number, F.lit("+ yrs experience")), F.array_join(degrees, " or ")), " · ")


def matched_pool(mandatory: Column, preferred: Column) -> Column:
    return F.array_distinct(F.concat(or_empty(mandatory), or_empty(preferred)))


def top_evidence(mandatory: Column, preferred: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(F.concat(or_empty(mandatory), or_empty(preferred)), 1, most), " · ")


def evidence_rows(lists: DataFrame) -> DataFrame:
    """Long form of score_list: for each category its matched, then its missing requirements."""
    rows = lambda c, hit: F.transform(c, lambda s, i: F.struct(F.lit(hit).alias("matched"), i.alias("pos"), s.alias("skill")))
    return lists.select("candidate_id", "role_id", "category", F.explode(F.concat(rows("matched", True), rows("missing", False))).alias("x")).select("candidate_id", "role_id", "category", "x.*")
