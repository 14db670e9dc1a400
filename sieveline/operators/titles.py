"""Relevance of a candidate's titles for a role, and resolution of a free-text role query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import titles
from ..functions.text import ROLE_STOPWORDS, TITLE_STOPWORDS, containment_norm, false_citation, jaccard, sequence_ratio, strip, text_or_empty, word_set
from ..session import ship
from .matching import Judge, contribution, judged_once, lexical_judge

# The likeness from which a latest title needs no judge; least overlap of a role; lead that settles a query.
BYPASS, OVERLAP, LEAD = 0.5, 0.20, 0.25


def title_match(pairs: DataFrame, judge: Judge = lexical_judge) -> DataFrame:
    """pairs (candidate_id, role_id, role_title, summary_title, experience) with worth, level, best_title, status and warning.

    The likeness of the latest title is computed once for each distinct pair of texts; only what it does not settle goes
    to the judge, all titles of a candidate at once. A reason that takes the role's own words for evidence counts as weak
    if a title shares a word with the role, else as none.
    """
    ship(pairs.sparkSession)
    rows = pairs.withColumn("titles", titles(F.col("summary_title"), F.col("experience"))).withColumn("target", strip(text_or_empty(F.col("role_title")))).drop("experience", "summary_title")
    none = (F.size("titles") == 0) | (F.length("target") == 0)
    empty = rows.where(none).select("candidate_id", "role_id", F.lit(0.0).alias("worth"), F.lit("none").alias("level"), F.lit(None).cast("string").alias("best_title"), F.lit(None).cast("string").alias("warning"))
    rows = rows.where(~none).withColumns({"a": containment_norm(F.col("target")), "b": containment_norm(F.try_element_at("titles", F.lit(1)))})
    ratios = rows.select("a", "b").distinct().withColumn("ratio", sequence_ratio("a", "b"))
    rows = rows.join(ratios, ["a", "b"]).drop("a", "b")
    near = rows.where(F.col("ratio") >= BYPASS)
    same = F.col("ratio") == 1
    near = near.select("candidate_id", "role_id", F.when(same, 1.0).otherwise(0.85).alias("worth"), F.when(same, "direct").otherwise("related").alias("level"), F.try_element_at("titles", F.lit(1)).alias("best_title"), F.lit(None).cast("string").alias("warning"))
    like = lambda t: jaccard(word_set(F.col("target"), TITLE_STOPWORDS), word_set(t, TITLE_STOPWORDS))
    order = lambda x, y: F.when(x["j"] > y["j"], -1).when(x["j"] < y["j"], 1).otherwise(x["i"] - y["i"])
    best = F.try_element_at(F.array_sort(F.transform("titles", lambda t, i: F.struct(like(t).alias("j"), i.alias("i"), t.alias("t"))), order), F.lit(1))
    far = rows.where(F.col("ratio") < BYPASS).withColumn("best", best)
    far = judged_once(far.withColumnsRenamed({"target": "requirement", "titles": "evidence"}), judge).withColumnsRenamed({"requirement": "target", "evidence": "titles"})
    wrong = F.when(contribution(F.col("level")) > 0, false_citation(F.col("reason"), F.array_join("titles", " | "), F.col("target")))
    far = far.withColumn("warning", wrong)
    far = far.withColumn("level", F.when(F.col("warning").isNull(), F.col("level")).when(F.col("best.j") > 0, "weak").otherwise("none"))
    far = far.select("candidate_id", "role_id", contribution(F.col("level")).alias("worth"), "level", F.col("best.t").alias("best_title"), "warning")
    return empty.unionByName(near).unionByName(far).withColumn("status", F.when(F.col("worth") >= 1, "matched").when(F.col("worth") > 0, "related").otherwise("missing"))


def resolve_roles(queries: DataFrame, roles: DataFrame, most: int = 5) -> DataFrame:
    """query, status (matched, ambiguous, no_match), role_ids: the roles whose titles share enough words with a query.

    Words join words, so only roles with one in common are compared. One role, or one with enough lead, matches; of
    several the first ``most`` are listed, by overlap and role_id. Roles and queries that agree count once.
    """
    asked = queries.select("query").distinct().withColumn("q", word_set(F.col("query"), ROLE_STOPWORDS))
    known = roles.select("role_id", "role_title").distinct().withColumn("t", word_set(F.col("role_title"), ROLE_STOPWORDS))
    shared = asked.select("query", F.size("q").alias("nq"), F.explode("q").alias("w")).join(known.select("role_id", "role_title", F.size("t").alias("nt"), F.explode("t").alias("w")), "w")
    shared = shared.groupBy("query", "role_id", "role_title", "nq", "nt").agg(F.count(F.lit(1)).alias("c")).withColumn("score", F.col("c") / (F.col("nq") + F.col("nt") - F.col("c")))
    shared = shared.where(F.col("score") >= OVERLAP).groupBy("query", "role_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "role_id")
    ranked = shared.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= max(most, 2))  # limited before it is shuffled
    listed = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rnk", "role_id", "score"))).alias("r"))
    listed = listed.join(shared.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "query")
    at = lambda n: F.try_element_at("r", F.lit(n))["score"]
    listed = listed.select("query", F.slice("r", 1, most).alias("r"), "n", (at(1) - F.coalesce(at(2), F.lit(0.0))).alias("lead"))
    out = asked.join(listed, "query", "left")
    settled = (F.col("n") == 1) | (F.col("lead") >= LEAD)
    ids = F.transform("r", lambda r: r["role_id"])
    return out.select(
        "query", F.when(F.col("n").isNull(), "no_match").when(settled, "matched").otherwise("ambiguous").alias("status"),
        F.when(F.col("n").isNull(), F.array().cast("array<string>")).when(settled, F.slice(ids, 1, 1)).otherwise(ids).alias("role_ids"),
    )
