"""Evidence chunks of candidates and BM25+ over them. The corpus of a requirement is its candidate's own chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import or_empty
from .percandidate import BestChunks, gathered, passed


def _given(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def _tools(c: Column) -> Column:
    return F.when(F.size(or_empty(c)) > 0, F.concat(F.lit("Tools/technologies used: "), F.array_join(c, ", ")))


def chunk_list(skills: str = "skills") -> Column:
    """The chunks (chunk_no, text, source_type, source_label) of a resume's columns, as evidence_chunks lists them."""
    item = lambda text, kind, label: F.struct(F.trim(text).alias("text"), F.lit(kind).alias("source_type"), label.alias("source_label"))
    or_ = lambda c, other: F.coalesce(_given(c), F.lit(other))
    domain = lambda e: F.concat(F.lit("Industry/domain: "), _given(e["domain"]))
    jobs = F.transform("experience", lambda e: item(F.concat_ws(" ", _given(e["description"]), domain(e), _tools(e["technologies_used"])), "experience", F.concat(or_(e["title"], "unknown title"), F.lit(" at "), or_(e["company"], "unknown company"))))
    projects = F.transform("projects", lambda p: item(F.concat_ws(" ", _given(p["description"]), _tools(p["technologies_used"])), "project", or_(p["title"], "unknown project")))
    listed = F.array(item(F.array_join(or_empty(F.col(skills)), ", "), "skills", F.lit("Skills section")))
    none = F.array().cast("array<struct<text:string,source_type:string,source_label:string>>")
    chunks = F.filter(F.concat(F.coalesce(jobs, none), F.coalesce(projects, none), listed), lambda c: F.length(c["text"]) > 0)
    return F.transform(chunks, lambda c, i: F.struct(i.alias("chunk_no"), c["text"].alias("text"), c["source_type"].alias("source_type"), c["source_label"].alias("source_label")))


def plain_chunks(skills: str = "skills") -> Column:
    """chunk_list with number and text only, as chunks."""
    return F.transform(chunk_list(skills), lambda c: F.struct(c["chunk_no"].alias("chunk_no"), c["text"].alias("text"))).alias("chunks")


def evidence_chunks(resumes: DataFrame, skills: str = "skills") -> DataFrame:
    """candidate_id, chunk_no, text, source_type, source_label: a chunk for each job, each project and the list of skills.

    Chunks without text are left out; chunk_no counts those that remain, in that order.
    """
    return resumes.select("candidate_id", F.explode(chunk_list(skills)).alias("c")).select("candidate_id", "c.*")


def bm25_top(chunks: DataFrame, requirements: DataFrame, top_k: int = 3, min_score: float = 0.0, delta_on_absent: bool = True) -> DataFrame:
    """candidate_id, requirement, chunk_no, score, rnk: the best chunks for each requirement of a candidate.

    ``requirements`` has candidate_id and requirement. The top_k are taken first, and of those the ones over min_score
    stay; scores equal to nine digits keep the order of chunks. A term asked for twice counts twice. With ``delta_on_absent`` a term
    that some chunk of the candidate holds adds its floor to the others too.
    """
    held = chunks.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_no").cast("int").alias("chunk_no"), "text"))).alias("chunks"))
    return best_chunks(gathered(requirements.where("requirement is not null").distinct()), held, top_k, min_score, delta_on_absent)


def best_chunks(asked: DataFrame, held: DataFrame, top_k: int = 3, min_score: float = 0.0, delta_on_absent: bool = True) -> DataFrame:
    """bm25_top of rows that hold a candidate each: asked (candidate_id, requirements), held (candidate_id, chunks as plain_chunks makes them)."""
    return passed(asked.join(held, "candidate_id"), BestChunks(top_k, min_score, delta_on_absent))
