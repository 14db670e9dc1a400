"""Queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import abuse, canonical, leakage, mixing, names, pii, topn


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.found(table(spark, sf_dir, "scores"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found({name: table(spark, sf_dir, name) for name in ("resumes", "jds", "skill_ref", "title_ref")})


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field and number of the values that no entry was found for."""
    rows = p3_found(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("n_values"), F.sum((F.col("ref_id") == canonical.UNMATCHED).cast("long")).alias("n_unmatched"))
    return rows


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(table(spark, sf_dir, "resumes"))


def p5_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its class of like records and the number of its links."""
    return names.persons(table(spark, sf_dir, "resumes"))


def p5_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company text with the firm it stands for."""
    return names.firm_table(table(spark, sf_dir, "resumes"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "resumes"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searched texts with typed placeholders."""
    return pii.redacted(table(spark, sf_dir, "resumes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents give away each item."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "test_set").distinct()
    return leakage.item_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).join(items, "item_id", "right").fillna({"n_docs": 0})


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, and what it falls short."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p5_found": p5_found, "p5_persons": p5_persons, "p5_firms": p5_firms, "p6_found": p6_found, "p6_redacted": p6_redacted, "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}

ORACLE = {
    "p2_found": """
        WITH latest AS (
            SELECT role_id, run_id, candidate_id, max(id) AS id
            FROM scores WHERE role_id IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL),
        kept AS (
            SELECT DISTINCT s.role_id, s.run_id, s.candidate_id, s.id, s.final_score
            FROM scores s JOIN latest l ON s.role_id = l.role_id AND s.run_id = l.run_id AND s.id = l.id
             AND s.candidate_id IS NOT DISTINCT FROM l.candidate_id
            WHERE s.final_score IS NOT NULL),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY role_id, run_id ORDER BY final_score DESC, candidate_id) AS INTEGER) AS rnk FROM kept)
        SELECT role_id, run_id, rnk, id FROM ranked WHERE rnk <= 3""",
}
