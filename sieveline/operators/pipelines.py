"""Whole ways: documents into records, a role query into ranked scores, and why a score is what it is."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import all_skills, atomize, dedupe_jobs, dropped_companies, or_empty, recovered, technologies
from ..functions.text import slugify
from ..schemas import CATEGORIES, JD_OUTPUT, RESUME_OUTPUT
from ..session import cut
from .experience import total_years
from .guards import guard_jd, guard_resume, salvage_json
from .matching import Judge, lexical_judge
from .providers import Structure, structured
from .scoring import WEIGHTS, fit_evidence, fit_parts, fit_scores, rank_all
from .titles import resolve_roles


#: Roles that one call of analyze scores all candidates for.
ROLES_ASKED = 100


def _said(warnings: list[Column]) -> Column:
    return F.filter(F.array(*warnings), lambda w: w.isNotNull())


def _records(texts: DataFrame, structure: Structure, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their record as columns, and those without one: file_name, error, raw_output."""
    rows = structured(texts.withColumn("file_name", F.element_at(F.split("path", "/"), -1)), structure)
    rows = cut(rows.withColumn("_json", salvage_json(F.col("output"), schema)))
    error = F.coalesce("error", F.when(F.col("_json.error").isNotNull(), F.concat(F.lit("structuring: "), F.col("_json.error"))))
    bad = rows.where(error.isNotNull()).select("file_name", error.alias("error"), F.col("_json.raw_output").alias("raw_output"))
    return rows.where(error.isNull()).select("file_name", "text", F.col("method").alias("extraction_method"), or_empty(F.col("warnings")).alias("_warnings"), "_json.value.*"), bad


def ingest_resumes(texts: DataFrame, structure: Structure, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """Resumes made of documents (path, text, method, warnings, error, as read_documents gives them), and rejected files.

    Equal jobs are put together, skills of labelled lines taken up again, skills, certificates and the title of the
    summary dropped where the text does not bear them out; then years are reckoned, skills of all sources listed, and
    companies looked for that the record lost. Each step tells what it did in extraction_warnings, in this order.
    """
    rows, bad = _records(texts, structure, RESUME_OUTPUT)
    rows = rows.withColumns({"candidate_id": F.expr("uuid()"), "document_id": F.expr("uuid()"), "uploaded_at": F.current_timestamp(), "experience": dedupe_jobs(F.col("experience"))})
    known = F.concat(or_empty(F.col("skills")), technologies(F.col("experience")), technologies(F.col("projects")))
    rows = cut(rows.withColumn("_more", recovered(F.col("text"), known)).withColumn("skills", F.concat(or_empty(F.col("skills")), F.col("_more"))))  # ids stay from here
    rows = guard_resume(rows, "text", ("skills", "certifications"), "current_role_title_from_summary").withColumnRenamed("guard_warnings", "_guard")
    years = total_years(rows.withColumn("office_zone", F.lit(None).cast("string")), as_of, "stated_years_experience_from_summary")
    rows = rows.drop("total_years_experience").join(years.select("candidate_id", F.col("total_years").alias("total_years_experience"), F.col("warnings").alias("_years")), "candidate_id")
    rows = rows.withColumn("skills_all_sources", all_skills(F.col("skills"), F.col("experience"), F.col("projects"), F.col("certifications")))
    lost = dropped_companies(F.col("text"), F.transform("experience", lambda e: e["company"]))
    rows = rows.withColumn("_lost", lost)
    told = _said([F.when(F.size("_more") > 0, F.concat(F.lit("skills: taken from labelled lines: "), F.array_join("_more", ", ")))])
    gone = _said([F.when(F.size("_lost") > 0, F.concat(F.lit("experience: companies of the text that are missing: "), F.array_join("_lost", ", ")))])
    rows = rows.withColumn("extraction_warnings", F.concat("_warnings", told, "_guard", "_years", gone))
    return rows.drop("text", "_warnings", "_more", "_guard", "_years", "_lost"), bad


def ingest_jds(texts: DataFrame, structure: Structure) -> tuple[DataFrame, DataFrame]:
    """Job descriptions made of documents as in ingest_resumes, and rejected files.

    Lists of skills are split into single skills, years and degrees dropped where the text names none, and the role_id is
    the title as a slug.
    """
    rows, bad = _records(texts, structure, JD_OUTPUT)
    lists = ("mandatory_skills", "preferred_technical_skills", "soft_preferred_skills")
    rows = guard_jd(rows.withColumns({c: atomize(F.col(c)) for c in lists}), "text")
    rows = rows.withColumns({"document_id": F.expr("uuid()"), "role_id": slugify(F.col("role_title")), "uploaded_at": F.current_timestamp(), "extraction_warnings": F.concat("_warnings", "guard_warnings")})
    return cut(rows.drop("text", "_warnings", "guard_warnings")), bad


def upload_results(records: DataFrame, rejected: DataFrame, key: str = "candidate_id") -> DataFrame:
    """file_name, status, candidate_id, error of ingested and rejected files, for progress_events."""
    fine = records.select("file_name", F.lit("ok").alias("status"), F.col(key).alias("candidate_id"), F.lit(None).cast("string").alias("error"))
    return fine.unionByName(rejected.select("file_name", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("candidate_id"), "error"))


def analyze(role_query: str | DataFrame, jds: DataFrame, resumes: DataFrame, judge: Judge = lexical_judge, candidate_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, status, role_ids) and the ranked scores of every candidate for the role of each query that means one.

    ``role_query`` is a text or a DataFrame of them (query); jds and resumes have one row for each role and candidate;
    candidate_ids (candidate_id) limits the candidates. Scores have query, role_id, candidate_id, candidate_name,
    category_scores, final_score, hard_gate_failed, hard_gate_reason, gate_missing, evidence and rank: all that pass the
    gate stand before those that fail it.
    """
    spark = jds.sparkSession
    asked = spark.createDataFrame([(role_query,)], "query string") if isinstance(role_query, str) else role_query.select("query")
    resolved = cut(resolve_roles(asked, jds))
    chosen = resolved.where("status = 'matched'").select("query", F.element_at("role_ids", 1).alias("role_id"))
    people = resumes if candidate_ids is None else resumes.join(candidate_ids.select("candidate_id").distinct(), "candidate_id", "left_semi")
    # Every candidate is scored against the role asked for: this product is the question itself.
    roles = [r["role_id"] for r in chosen.select("role_id").distinct().limit(ROLES_ASKED + 1).collect()]
    if len(roles) > ROLES_ASKED:
        raise ValueError(f"more than {ROLES_ASKED} roles are asked for at once")
    pairs = people.select("candidate_id", F.explode(F.array(*[F.lit(r) for r in roles]).cast("array<string>")).alias("role_id"))
    parts = fit_parts(pairs, people, jds.where(F.col("role_id").isin(roles)), judge)
    scores = fit_scores(parts).join(fit_evidence(parts), ["candidate_id", "role_id"]).join(people.select("candidate_id", "candidate_name"), "candidate_id")
    gated = F.coalesce("hard_gate_failed", F.lit(False))
    ranked = rank_all(scores.withColumn("_part", F.concat_ws("|", "role_id", gated.cast("string"))), "_part").drop("_part")
    passed = scores.where(~gated).groupBy("role_id").agg(F.count(F.lit(1)).alias("_passed"))
    ranked = ranked.join(F.broadcast(passed), "role_id", "left").withColumn("rank", F.col("rank") + F.when(gated, F.coalesce("_passed", F.lit(0))).otherwise(0)).drop("_passed")
    return resolved, chosen.join(ranked, "role_id")


def candidate_place(ranked: DataFrame, candidate_id: str) -> DataFrame:
    """A candidate's rows of a ranking, with the number of candidates each is among."""
    among = ranked.groupBy("role_id").agg(F.count(F.lit(1)).alias("among"))
    return ranked.where(F.col("candidate_id") == candidate_id).join(among, "role_id")


def explain_match(parts: dict[str, DataFrame]) -> DataFrame:
    """candidate_id, role_id, line_no, line: the scores and the evidence of fit_parts as lines to read, in the order they are to be read."""
    both = fit_scores(parts).join(fit_evidence(parts), ["candidate_id", "role_id"])
    scores = [F.concat(F.lit(f"{c}: "), F.col("category_scores")[c].cast("string"), F.lit(f"/{round(WEIGHTS[c] * 100, 2):g}")) for c in CATEGORIES]

    def shown(r: Column) -> Column:
        mark = F.when(r["status"] == "missing", "- ").otherwise("+ ")
        by = F.when(F.length(r["matched_against"]) > 0, F.concat(F.lit(" by "), r["matched_against"])).otherwise("")
        said = F.when(F.length(r["judge_reason"]) > 0, F.concat(F.lit(" ("), r["judge_reason"], F.lit(")"))).otherwise("")
        return F.concat(mark, r["skill"], F.lit(": "), r["status"], F.lit(", "), r["match_type"], F.lit(" "), r["contribution"].cast("string"), by, said)

    lists = [F.concat(F.array(F.lit(f"[{c}]")), F.transform(F.col("evidence")[c], shown)) for c in ("mandatory_skills", "preferred_skills", "soft_skills", "industry_keywords")]
    rest = F.array(
        F.concat(F.lit("job_title: "), F.coalesce(F.to_json("evidence.job_title"), F.lit("none"))), F.concat(F.lit("experience: "), F.coalesce(F.to_json("evidence.experience"), F.lit("not asked for"))),
        F.concat(F.lit("education: "), F.coalesce(F.to_json("evidence.education"), F.lit("not asked for"))), F.concat(F.lit("more skills: "), F.array_join("evidence.additional_candidate_skills", ", ")),
        F.concat(F.lit("final_score: "), F.col("final_score").cast("string"), F.lit(", hard_gate_failed: "), F.col("hard_gate_failed").cast("string"), F.lit(" "), F.col("hard_gate_reason")),
    )
    lines = F.concat(F.array(*scores), *lists, rest)
    return both.select("candidate_id", "role_id", F.posexplode(lines).alias("line_no", "line"))


def batch_without(batch: DataFrame, file_names: list[str]) -> DataFrame:
    """An upload's results (file_name, ...) without some of its files; an empty list leaves all."""
    return batch.where(~F.coalesce(F.col("file_name").isin(file_names), F.lit(False))) if file_names else batch
