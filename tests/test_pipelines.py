import datetime as dt
import json

from helpers import F, rows

from sieveline.operators import pipelines, providers, scoring
from sieveline.sources import files, store

TODAY = dt.date(2025, 7, 1)
RESUME = """Ann Berg
Skills: SQL, dbt, Airflow
Acme Ltd
Jan 2020 - Mar 2022
Other Works
2018 - 2019
Senior Data Engineer, 12 years of experience"""
RECORD = {
    "candidate_name": "Ann Berg", "current_role_title_from_summary": "Astronaut", "stated_years_experience_from_summary": 12, "skills": ["SQL", "Rust"],
    "experience": [{"title": "Data Engineer", "company": "Acme Ltd", "start_date_raw": "Jan 2020", "end_date_raw": "Mar 2022", "technologies_used": ["dbt"]}] * 2, "certifications": ["Tools: Kafka, Flink"], "projects": None,
}
JD = {"role_title": "Senior Data Engineer (Platform)", "mandatory_skills": ["Strong SQL and good Python skills."], "min_years_experience": 5, "education_requirements": [{"degree_level": "BSc", "field": "Law", "required": True}]}


def model():
    """Stands for a model; made inside a function so that it travels to the executors by value."""

    def structure(text):
        if "break" in text:
            raise RuntimeError("model is away")
        return "no json here" if "garble" in text else "Sure: " + json.dumps(JD if "role" in text else RECORD)

    return structure


def texts(spark, *pairs):
    return spark.createDataFrame([(f"in/{n}", t, "txt", ["scan"] if n == "a.txt" else [], None if t is not None else "BadZipFile: x") for n, t in pairs], "path string, text string, method string, warnings array<string>, error string")


def test_resumes(spark):
    fine, bad = pipelines.ingest_resumes(texts(spark, ("a.txt", RESUME), ("b.txt", "garble"), ("c.txt", "break"), ("d.docx", None), ("e.txt", "")), model(), TODAY)
    r = fine.collect()
    assert len(r) == 1 and fine.count() == 1 and r[0]["candidate_id"] == fine.first()["candidate_id"]
    r = r[0]
    assert r["skills"] == ["SQL", "Airflow"] and r["skills_all_sources"] == ["SQL", "Airflow", "dbt"] and len(r["experience"]) == 1 and r["current_role_title_from_summary"] == ""
    assert r["total_years_experience"] == 12 and r["certifications"] == []
    heads = [w.split(":")[0] for w in r["extraction_warnings"]]
    assert heads == ["scan", "skills", "skills", "certifications", "current_role_title_from_summary", "stated years are more than the dates show", "experience"] and "Other Works" in r["extraction_warnings"][-1]
    errors = {b["file_name"]: b["error"] for b in bad.collect()}
    assert errors == {"b.txt": "structuring: no JSON", "c.txt": "RuntimeError: model is away", "d.docx": "BadZipFile: x", "e.txt": "ValueError: no text"}
    events = files.progress_events(pipelines.upload_results(fine, bad), 5)
    lines = [json.loads(e["json"]) for e in events.orderBy("seq").collect()]
    assert lines[0]["total"] == 5 and [x["status"] for x in lines[1:]] == ["failed"] * 4 + ["ok"]
    assert pipelines.batch_without(pipelines.upload_results(fine, bad), ["b.txt", "zz"]).count() == 4 and pipelines.batch_without(bad, []).count() == 4


def test_jds(spark):
    fine, bad = pipelines.ingest_jds(texts(spark, ("a.txt", "role: data. SQL, Python; 5 years")), model())
    r = fine.first()
    assert r["role_id"] == "senior-data-engineer-platform" and r["mandatory_skills"] == ["SQL", "Python"] and r["min_years_experience"] == 5 and r["education_requirements"] == [] and len(r["extraction_warnings"]) == 2
    assert bad.collect() == []


def test_analyze(spark, tmp_path):
    people, _ = pipelines.ingest_resumes(texts(spark, ("a.txt", RESUME), ("z.txt", RESUME.replace("SQL", "Cobol"))), model(), TODAY)
    roles, _ = pipelines.ingest_jds(texts(spark, ("a.txt", "role: data. SQL, Python; 5 years, a degree")), model())
    more = roles.withColumns({"role_id": F.lit("cook"), "role_title": F.lit("Cook"), "mandatory_skills": F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.concat(F.lit("dish"), n.cast("string")))})
    resolved, scores = pipelines.analyze("data engineer platform", roles.unionByName(more), people)
    assert rows(resolved.select("status")) == [("matched",)]
    got = scores.orderBy("rank").collect()
    assert [g["rank"] for g in got] == [1, 2] and got[0]["evidence"]["mandatory_skills"][0]["matched_against"] == "SQL" and got[0]["final_score"] > got[1]["final_score"] and got[0]["candidate_name"] == "Ann Berg"
    assert rows(pipelines.candidate_place(scores, got[1]["candidate_id"]).select("rank", "among")) == [(2, 2)]
    one = people.where(F.col("candidate_id") == got[0]["candidate_id"])
    _, few = pipelines.analyze("data engineer platform", roles, people, candidate_ids=one)
    assert few.count() == 1
    _, failed = pipelines.analyze("cook", roles.unionByName(more), people)
    assert {r["hard_gate_failed"] for r in failed.collect()} == {True}
    assert [r["status"] for r in pipelines.analyze("astronaut", roles, people)[0].collect()] == ["no_match"] and pipelines.analyze("astronaut", roles, people)[1].collect() == []
    store.append_scores(store.stamped(scores.withColumn("evidence", F.to_json("evidence"))), str(tmp_path / "scores"))
    assert store.scores_of_role(spark, str(tmp_path / "scores"), got[0]["role_id"]).count() == 2


def test_explain(spark):
    people, _ = pipelines.ingest_resumes(texts(spark, ("a.txt", RESUME)), model(), TODAY)
    roles, _ = pipelines.ingest_jds(texts(spark, ("a.txt", "role: data. SQL, Python; 5 years, a degree")), model())
    pairs = people.select("candidate_id").withColumn("role_id", F.lit("senior-data-engineer-platform"))
    lines = [r["line"] for r in pipelines.explain_match(scoring.fit_parts(pairs, people, roles)).orderBy("line_no").collect()]
    assert lines[0].startswith("mandatory_skills: ") and "+ SQL: matched, exact 1.0 by SQL" in lines and any(x.startswith("- Python: missing") for x in lines) and lines[-1].startswith("final_score: ")


def test_embedding_is_kept(spark, tmp_path):
    path, log = str(tmp_path / "vectors"), str(tmp_path / "log")

    def embed(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise ValueError("no")
        return [len(text), 1]

    df = spark.createDataFrame([("ab",), ("ab",), (None,), ("bad",)], "t string")
    first = rows(providers.embedded(df, "t", embed, path))
    assert first == sorted([("ab", [2.0, 1.0]), ("ab", [2.0, 1.0]), (None, None), ("bad", None)], key=repr)
    providers.embedded(df.union(spark.createDataFrame([("abc",)], "t string")), "t", embed, path).collect()
    assert sorted(open(log).read().split()) == ["ab", "abc", "bad", "bad"]


def test_saving_files(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", b"one"), ("../x/b.txt", b"two"), ("a/..", b"no"), (None, b"no"), ("c.txt", None)], "file_name string, content binary")
    got = {r["file_name"]: (r["bytes"], r["error"]) for r in files.save_files(df, str(tmp_path / "in")).collect()}
    assert got["a.txt"] == (3, None) and got["../x/b.txt"] == (3, None) and got["a/.."][1] and got[None][1] and got["c.txt"][1]
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["a.txt", "b.txt"]
    dump = files.raw_dumps(files.read_documents(spark, str(tmp_path / "in"))).where("path like '%a.txt'").first()["dump"]
    assert dump == "[extraction_method=txt]\n[char_count=3]\n\none"
