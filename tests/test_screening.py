import math
import re
from collections import Counter

import pytest
from helpers import F, job, one, resume, resumes, rows
from pyspark.sql import Row

from sieveline.operators import guards, layout, matching, retrieval, scoring, titles

STRINGS = "array<string>"


@pytest.mark.parametrize("req, skills, found", [("ETL", ["ELT"], "ELT"), ("Data Validation", ["Data"], None), ("Java", ["JavaScript", "core java"], "core java"), ("advanced Power BI use", ["Power BI"], "Power BI"), ("SQL", None, None), ("", ["x"], None), ("SQL", [None, " sql "], " sql ")])
def test_exact_skill(spark, req, skills, found):
    assert one(spark, matching.exact_skill(F.col("a"), F.col("b")), a=(req, "string"), b=(skills, STRINGS)) == found


def test_exact_matches_agree_with_the_expression(spark):
    texts = ["ETL", "elt", "ELT pipelines", "Java", "core java", "JavaScript", "C", "C++", "c++ (modern)", "++", "#", "C#", ".NET", "asp.net", "Power BI", "advanced Power BI use", "power", " sql ", "SQL", "", " ", None, "R", "r & d", "machine learning", "applied machine learning"]
    asked = spark.createDataFrame([(c, t) for c in "abc" for t in texts], "candidate_id string, requirement string").where("requirement is not null")
    held = spark.createDataFrame([("a", texts), ("b", texts[::-1]), ("d", ["SQL"])], "candidate_id string, skills array<string>")
    want = asked.join(held, "candidate_id", "left").select("candidate_id", "requirement", matching.exact_skill(F.col("requirement"), F.col("skills")).alias("matched"))
    assert rows(matching.exact_matches(asked, held).select("candidate_id", "requirement", "matched")) == rows(want)
    assert matching.exact_matches(asked.limit(0), held).collect() == [] and {r["matched"] for r in matching.exact_matches(asked, held.limit(0)).collect()} == {None}


def test_a_judge_is_asked_once_for_each_question(spark, tmp_path):
    log = str(tmp_path / "asked")

    def ask(requirement, evidence):
        with open(log, "a") as f:
            f.write(requirement + "\n")
        if requirement == "bad":
            raise ValueError("no model")
        return {"match": " Direct ", "confidence": 7, "reason": "yes"} if requirement == "SQL" else {"match": "perhaps"}

    asked = spark.createDataFrame([("SQL", ["a"]), ("SQL", ["a"]), ("Go", ["a"]), ("bad", ["a"]), ("none", [])], "requirement string, evidence array<string>")
    got = {r["requirement"]: (r["level"], r["confidence"], r["reason"]) for r in matching.asked_judge(ask)(asked).collect()}
    assert got == {"SQL": ("direct", 1.0, "yes"), "Go": ("none", 0.0, ""), "bad": ("none", 0.0, "no answer: no model"), "none": ("none", 1.0, "no evidence")}
    assert sorted(open(log).read().split()) == ["Go", "SQL", "bad"]


def test_levels(spark):
    df = spark.createDataFrame([("direct",), ("related",), ("weak",), ("none",), ("x",), (None,)], "l string")
    got = [tuple(r) for r in df.select(matching.contribution(F.col("l")), matching.evidence_status(matching.contribution(F.col("l")))).collect()]
    assert got == [(1.0, "matched"), (0.7, "weak_match"), (0.35, "weak_match"), (0.0, "missing"), (0.0, "missing"), (0.0, "missing")]
    clean = one(spark, matching.clean_judgement(F.lit("huge"), F.lit(7.0)))
    assert tuple(clean) == ("none", 1.0)


def people(spark):
    return resumes(
        spark,
        resume("a", skills=["SQL", "Go"], experience=[job("2020", "2021", "A", "Data Engineer", "built data pipelines in python", ["Airflow"], "Retail"), job(company=None, title=None, description="data data sql reports")], projects=[("P", "python tool", None)]),
        resume("b", skills=None, experience=[]),
    )


def test_chunks(spark):
    got = [tuple(r) for r in retrieval.evidence_chunks(people(spark)).orderBy("candidate_id", "chunk_no").collect()]
    assert got[0] == ("a", 0, "built data pipelines in python Industry/domain: Retail Tools/technologies used: Airflow", "experience", "Data Engineer at A")
    assert [g[1] for g in got] == [0, 1, 2, 3] and got[1][4] == "unknown title at unknown company" and got[3][2] == "SQL, Go"


@pytest.mark.parametrize("delta", [True, False])
def test_bm25_against_brute_force(spark, delta):
    chunks = retrieval.evidence_chunks(people(spark))
    asked = ["python data data", "SQL", "nothing here"]
    docs = [re.findall("[a-z0-9]+", r["text"].lower()) for r in chunks.where("candidate_id = 'a'").orderBy("chunk_no").collect()]
    avg = sum(map(len, docs)) / len(docs)
    want = set()
    for q in asked:
        score = [0.0] * len(docs)
        for t in re.findall("[a-z0-9]+", q.lower()):
            df = sum(t in d for d in docs)
            if df:
                idf = math.log((len(docs) + 1) / df)
                for i, d in enumerate(docs):
                    tf = Counter(d)[t]
                    if tf or delta:
                        score[i] += idf * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * len(d) / avg) + tf))
        order = sorted(range(len(docs)), key=lambda i: (-score[i], i))[:2]
        want |= {(q, i, n + 1, round(score[i], 6)) for n, i in enumerate(order) if score[i] > 0}
    reqs = spark.createDataFrame([("a", q) for q in asked] + [("b", "SQL")], "candidate_id string, requirement string")
    got = retrieval.bm25_top(chunks, reqs, 2, delta_on_absent=delta)
    assert {(r["requirement"], r["chunk_no"], r["rnk"], round(r["score"], 6)) for r in got.collect()} == want


def test_skill_scores_with_a_table_of_judgements(spark):
    pairs = spark.createDataFrame([("a", "r", "m", 0, "SQL"), ("a", "r", "m", 1, "python pipelines"), ("a", "r", "m", 2, "law"), ("b", "r", "m", 0, "SQL")], "candidate_id string, role_id string, category string, pos int, requirement string")
    judge = lambda asked: asked.withColumn("level", F.lit("weak")).withColumn("reason", F.lit("said so"))
    got = {(r["candidate_id"], r["requirement"]): r for r in matching.score_skills(pairs, people(spark), judge).collect()}
    assert [(got[k]["match_type"], got[k]["worth"], got[k]["clears_gate"]) for k in (("a", "SQL"), ("a", "python pipelines"), ("a", "law"), ("b", "SQL"))] == [("exact", 1.0, True), ("evidence", 0.35, False), ("none", 0.0, False), ("none", 0.0, False)]
    lists = {r["candidate_id"]: r for r in matching.score_list(matching.score_skills(pairs, people(spark), judge), "candidate_id").collect()}
    assert (lists["a"]["matched"], lists["a"]["missing"], lists["a"]["gate_missing"]) == (["SQL", "python pipelines"], ["law"], ["python pipelines", "law"])
    known = spark.createDataFrame([("python pipelines", 1, "direct", "x")], "requirement string, evidence_hash long, level string, reason string")
    assert {r["level"] for r in matching.score_skills(pairs, people(spark), matching.table_judge(known)).where("match_type != 'exact'").collect()} == {"none"}
    assert matching.score_skills(pairs.limit(0), people(spark)).collect() == []


def test_titles(spark):
    jobs = "array<struct<title:string,company:string,start_date_raw:string,end_date_raw:string,domain:string,description:string,technologies_used:array<string>>>"
    one_job = lambda t: [job(title=t)]
    df = spark.createDataFrame(
        [("same", "r", "Data Engineer", None, one_job("Data Engineer")), ("near", "r", "Data Engineer", None, one_job("Data Engineers II")), ("far", "r", "Data Engineer", None, one_job("Cook of data")), ("none", "r", "Data Engineer", None, None), ("blank", "r", " ", None, one_job("Cook"))],
        f"candidate_id string, role_id string, role_title string, summary_title string, experience {jobs}",
    )
    claims = lambda asked: asked.withColumn("level", F.lit("direct")).withColumn("reason", F.lit("it states 'Data Engineer'"))
    got = {r["candidate_id"]: (r["worth"], r["level"]) for r in titles.title_match(df, claims).collect()}
    assert got == {"same": (1.0, "direct"), "near": (0.85, "related"), "far": (0.35, "weak"), "none": (0.0, "none"), "blank": (0.0, "none")}


def test_role_resolution(spark):
    roles = spark.createDataFrame([("1", "AI Engineer"), ("2", "Sales Executive"), ("3", "Senior AI Engineer"), ("4", None), ("1", "AI Engineer")], "role_id string, role_title string")
    asked = spark.createDataFrame([("the sales role",), ("AI Engineer",), ("the job",), ("cook",), (None,), ("engineer of AI systems",)], "query string")
    got = {r["query"]: (r["status"], r["role_ids"]) for r in titles.resolve_roles(asked, roles).collect()}
    assert got["the sales role"] == ("matched", ["2"]) and got["AI Engineer"] == ("matched", ["1"]) and got["the job"] == ("no_match", []) and got["cook"][0] == "no_match" and got[None][0] == "no_match"
    assert got["engineer of AI systems"] == ("ambiguous", ["1", "3"])


def test_scores(spark):
    f = lambda what, **v: one(spark, what, **v)
    assert [f(scoring.experience_score(F.col("t"), F.col("m")), t=(t, "double"), m=(m, "double")) for t, m in ((4.9, None), (4.9, 0.0), (4.9, 5.0), (None, 1.0), (5.0, 5.0))] == [25.0, 25.0, 0.0, 0.0, 25.0]
    edu, req = "array<struct<degree_level:string,field:string,institution:string>>", "array<struct<degree_level:string,field:string,required:boolean>>"
    met = lambda r, e: f(scoring.education_score(F.col("r"), F.col("e")), r=(r, req), e=(e, edu))
    phd, master = [Row("PhD", "Physics", None)], [Row("Master's", "Physics", None)]
    assert met([Row("Master's", "", True)], phd) == 0 and met([Row("Bachelor's", "Physics", True)], master) == 20 and met([], None) == 20 and met(None, None) == 20 and met([Row("Bachelor's", None, None)], None) == 0
    assert [f(scoring.tier(F.col("s")), s=(s, "double")) for s in (87.0, 86.99, 82.0, 72.0, 71.99)] == ["excellent", "strong", "strong", "review", "low"]
    assert f(scoring.jd_summary(F.col("m"), F.col("r")), m=(3.0, "double"), r=([Row("BSc", "Law", None), Row(None, None, None)], req)) == "3+ yrs experience · BSc in Law"
    assert f(scoring.percent_of_most(F.lit(30.0), F.lit(25.0))) == 100
    assert f(scoring.top_evidence(F.col("a"), F.col("b")), a=(["x", "y"], STRINGS), b=(["z", "w"], STRINGS)) == "x · y · z"


def test_job_fit(spark):
    schema = "role_id string, role_title string, mandatory_skills array<string>, preferred_technical_skills array<string>, soft_preferred_skills array<string>, min_years_experience double, education_requirements array<struct<degree_level:string,field:string,required:boolean>>"
    jds = spark.createDataFrame([("r", "Data Engineer", ["SQL", "Go"], None, [], 1.0, None), ("s", None, ["law"] * 1 + [f"x{n}" for n in range(7)], [], [], None, [])], schema)
    pairs = spark.createDataFrame([("a", "r"), ("a", "s"), ("b", "r"), ("a", "r")], "candidate_id string, role_id string")
    got = {(r["candidate_id"], r["role_id"]): r for r in scoring.job_fit(pairs, people(spark), jds).collect()}
    assert len(got) == 3
    assert got["a", "r"]["final_score"] == 25 + 0 + 5 + 10 + 10 + 20 + 5 and not got["a", "r"]["hard_gate_failed"]
    assert got["a", "s"]["hard_gate_failed"] and got["a", "s"]["hard_gate_reason"].startswith("8 of 8 mandatory skills missing")
    parts = scoring.fit_parts(pairs, people(spark), jds)
    told = {(r["candidate_id"], r["role_id"]): r["evidence"] for r in scoring.fit_evidence(parts).collect()}
    row = told["a", "r"]["mandatory_skills"][0]
    assert len(told) == 3 and (row["skill"], row["status"], row["match_type"], row["matched_against"]) == ("SQL", "matched", "exact", "SQL") and told["a", "r"]["additional_candidate_skills"] == []
    assert told["a", "s"]["additional_candidate_skills"] == ["SQL", "Go"] and told["a", "s"]["experience"] is None and told["b", "r"]["experience"]["status"] == "missing" and told["b", "r"]["job_title"]["match_level"] == "none"
    ranked = scoring.rank_all(scoring.job_fit(pairs, people(spark), jds), "role_id")
    assert [r["rank"] for r in ranked.where("role_id = 'r'").orderBy("rank").collect()] == [1, 2]


def test_guards(spark):
    df = spark.createDataFrame([("I know SQL and data modelling", ["SQL", "Rust", "Modelling Data"], None, "Cook")], "text string, skills array<string>, certifications array<string>, title string")
    r = guards.guard_resume(df, "text", title="title").first()
    assert (r["skills"], r["title"], len(r["guard_warnings"])) == (["SQL", "Modelling Data"], "", 2)
    j = spark.createDataFrame([("5+ years", 5.0, [Row("BSc", "Law", True)]), (None, 5.0, None)], "t string, min_years_experience double, education_requirements array<struct<degree_level:string,field:string,required:boolean>>")
    assert rows(guards.guard_jd(j, "t").select("min_years_experience", F.size("guard_warnings"))) == [(0.0, 1), (5.0, 1)]
    got = [tuple(one(spark, guards.salvage_json(F.col("a"), "a int"), a=(x, "string"))) for x in ('say {"a": 1} end', "", None, "{oops")]
    assert got[0][0]["a"] == 1 and [g[1] for g in got] == [None, "empty", "empty", "no JSON"]


def test_two_columns(spark):
    schema = "doc_id string, page int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string"

    def cut(x0, y0, y1):
        rows_ = [("d", 1, 600.0, 100.0, float(x), float(a), x + 200.0, float(b), "t") for x, a, b in zip(x0, y0, y1)]
        return [r["at"] for r in layout.column_cuts(spark.createDataFrame(rows_, schema)).collect()]

    assert cut((10, 10, 300, 300), (0, 50, 0, 50), (40, 90, 40, 90)) == [155.0]
    assert cut((10, 12, 14, 300, 302), (0, 30, 60, 0, 50), (20, 50, 90, 40, 90)) == [156.5]
    assert cut((10, 10, 300), (0, 50, 0), (40, 90, 40)) == [] and cut((10, 10, 10, 300), (0, 50, 60, 0), (40, 55, 90, 90)) == []
    assert cut((10, 10, 300, 300), (0, 10, 80, 90), (10, 20, 90, 100)) == [] and cut((10, 10, 12, 12), (0, 50, 0, 50), (40, 90, 40, 90)) == [] and cut((10, 10, 10, 10), (0, 50, 0, 50), (40, 90, 40, 90)) == []
    b = [("d", 1, 600.0, 100.0, x, y, x + 200.0, y + 40.0, t) for x, y, t in ((10.0, 10.0, "l1"), (300.0, 10.0, "r1"), (10.0, 50.0, "l2"), (300.0, 50.0, "r2"), (0.0, 60.0, " "))]
    b.append(("d", 1, 600.0, 100.0, 0.0, 0.0, 600.0, 8.0, "head"))
    b.append(("e", 1, 600.0, 100.0, 0.0, 0.0, 100.0, 8.0, "only"))
    df = spark.createDataFrame(b, schema)
    assert rows(layout.reading_order(df)) == [("d", 1, True, "head\n\nl1\n\nl2\n\nr1\n\nr2"), ("e", 1, False, "only")]
