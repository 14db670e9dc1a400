"""Queries over candidates and roles hold every pair that was scored, not each candidate's best role alone."""

import duckdb
import pytest

import __spark_entry__ as entry


def scored(data, jds="TRUE"):
    sql = f"SELECT DISTINCT candidate_id, role_id FROM '{data}/scores.parquet' SEMI JOIN '{data}/resumes.parquet' USING (candidate_id) SEMI JOIN (SELECT * FROM '{data}/jds.parquet' WHERE {jds}) USING (role_id)"
    return set(duckdb.sql(sql).fetchall())


@pytest.mark.parametrize("name", ["job_fit", "title_ratio"])
def test_every_scored_pair_has_a_row(spark, data, name):
    got = [tuple(r) for r in entry.queries()[name](spark, data).select("candidate_id", "role_id").collect()]
    assert len(got) == len(set(got)) and set(got) == scored(data)
    assert len(got) > len({c for c, _ in got})


@pytest.mark.parametrize("name", ["skill_lists", "education_fit_all", "unused_skills_all"])
def test_every_scored_pair_that_asks_for_something_has_a_row(spark, data, name):
    got = [tuple(r) for r in entry.queries()[name](spark, data).select("candidate_id", "role_id").collect()]
    assert len(got) == len(set(got)) and set(got) <= scored(data)
    assert len(got) > len({c for c, _ in got})


@pytest.mark.parametrize("name", ["exact_skills_all", "bm25_evidence_all"])
def test_requirements_of_all_roles_are_looked_up(spark, data, name):
    few, all_ = (set(map(tuple, entry.queries()[n](spark, data).select("candidate_id", "requirement").collect())) for n in (name.removesuffix("_all"), name))
    assert few < all_
