"""What is asked of a candidate is looked up without shuffling candidates times requirements."""

import itertools
import re

import pytest

import __spark_entry__ as entry
from helpers import rows
from sieveline.operators import matching, percandidate, retrieval, scoring
from sieveline.plans import screening_queries


@pytest.mark.parametrize("name", ["bm25_evidence_all", "exact_skills_all", "skill_lists", "exact_skills", "job_fit", "job_fit_untitled"])
def test_requirements_of_candidates_are_not_shuffled(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\([^)]*requirement", plan)


def test_scores_that_only_differ_by_rounding_keep_the_order_of_chunks(spark):
    # Sums of the same parts in another order differ in the last digit, as they may on either chunk.
    chunks = spark.createDataFrame([("a", n, t) for n, t in enumerate(["x y z w", "w z y x", "y x w z", "z w x y", "none of it at"])], "candidate_id string, chunk_no int, text string")
    asked = spark.createDataFrame([("a", q) for q in ("x y z w", "w w z y x", "z x y"[::-1])] + [("b", "x"), ("a", None)], "candidate_id string, requirement string")
    got = retrieval.bm25_top(chunks, asked)
    assert {(r["requirement"], r["rnk"], r["chunk_no"]) for r in got.collect()} == {(q, n + 1, n) for q in ("x y z w", "w w z y x", "y x z") for n in range(3)}


def test_list_scores_agree_with_each_requirement_scored_alone(spark, data):
    jds, people = screening_queries.asked_lists(spark, data), screening_queries.people(spark, data, "experience", "projects", "skills")
    pairs = screening_queries.all_pairs(spark, data)

    def judge(asked):  # the same judge, without its form for words
        return matching.lexical_judge(asked)

    assert rows(matching.list_scores(pairs, jds, people)) == rows(matching.list_scores(pairs, jds, people, judge))


def test_fits_agree_with_each_part_scored_alone(spark, data):
    jds, people = screening_queries.current_jds(spark, data), screening_queries.people(spark, data, "experience", "projects", "skills", "education", "total_years_experience")
    pairs = screening_queries.all_pairs(spark, data)
    more = spark.createDataFrame([("odd", "share of words"), ("odd 2", "- / share of words | x"), ("odd 3", " ")], "role_id string, role_title string")
    jds = jds.unionByName(more, allowMissingColumns=True)
    pairs = pairs.unionByName(people.select("candidate_id").limit(40).crossJoin(more.select("role_id")))

    def judge(asked):  # the same judge, without its form for words
        return matching.lexical_judge(asked)

    one = scoring.job_fit(pairs, people, jds)
    assert rows(one) == rows(scoring.job_fit(pairs, people, jds, judge))


@pytest.mark.parametrize("name", ["job_fit_untitled", "skill_lists"])
def test_lists_of_roles_do_not_go_with_the_pairs(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set(role_id" in plan and "collect_list" not in plan


@pytest.mark.parametrize("name", ["job_fit_untitled", "skill_lists"])
def test_lists_that_do_not_fit_in_a_worker_give_the_same_rows(spark, data, name, monkeypatch):
    sent = rows(entry.queries()[name](spark, data))
    monkeypatch.setattr(percandidate, "fits", lambda df, most_bytes: False)
    assert sent and rows(entry.queries()[name](spark, data)) == sent


def test_requirements_that_share_nothing_with_a_candidate_are_not_looked_up():
    texts = ["sql", " SQL ", "c++", "C#", "#", "etl", "ELT", "elt tools", "data analysis", "big data analysis", "R&D", "--", "+ +", "ab+", "\x1c", " ", "", "ete", "a/b", "ELT+"]
    for have, asked in itertools.product(texts, texts):
        asked = percandidate.Requirement(asked)
        for skills, chunks in (([have], []), ([], [have]), ([have, "sql"], ["elt", have])):
            me = percandidate.Candidate(percandidate.skills_of(skills), list(enumerate(chunks)))
            if me.exact(asked) is not None or me.best(asked):
                assert me.near([asked])
    me = percandidate.Candidate(percandidate.skills_of(["SQL", "C++"]), [(0, "wrote SQL")])
    assert not me.near(map(percandidate.Requirement, ["python", "etl", "data analysis"]))
