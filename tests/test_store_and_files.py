import datetime as dt
import io
import json
import zipfile

import pytest
from helpers import F, rows

from sieveline.schemas import EVENT
from sieveline.sources import files, store
from sieveline.streaming import ingest

AT = [dt.datetime(2025, 1, d) for d in range(1, 10)]
SCORES = "id long, candidate_id string, role_id string, run_id string, final_score double, hard_gate_failed boolean, scored_at timestamp"


def test_latest_per_key_has_a_total_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), (None, 1, "n")], "k string, t int, v string")
    assert rows(store.latest_per_key(df, ["k"], ["t"])) == sorted([("a", 2, "z"), ("b", None, "q"), (None, 1, "n")], key=repr)
    assert store.latest_per_key(df.limit(0), ["k"], ["t"]).collect() == []


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    assert store.read_table(spark, path) is None
    store.upsert(first, path, ["k"], ["t"])
    out = store.upsert(spark.createDataFrame([("a", 2, "n", 5), ("c", 1, "z", 6)], "k string, t int, v string, extra int"), path, ["k"], ["t"])
    assert rows(out.select("k", "v", "extra")) == sorted([("a", "n", 5), ("b", "y", None), ("c", "z", 6)], key=repr)


def failing(spark, df):
    return df.withColumn("v", F.when(F.col("k") == "bad", F.raise_error(F.lit("broken row"))).otherwise(F.col("v")))


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, t int, v string"
    store.upsert(spark.createDataFrame([("a", 1, "x")], schema), path, ["k"], ["t"])
    with pytest.raises(Exception, match="broken row"):
        store.upsert(failing(spark, spark.createDataFrame([("a", 2, "y"), ("bad", 1, "z")], schema)), path, ["k"], ["t"])
    assert rows(store.read_table(spark, path)) == [("a", 1, "x")]
    assert rows(store.upsert(spark.createDataFrame([("b", 1, "y")], schema), path, ["k"], ["t"])) == [("a", 1, "x"), ("b", 1, "y")]


def test_an_overtaken_upsert_changes_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k string, t int, v string"
    store.upsert(spark.createDataFrame([("a", 1, "x")], schema), path, ["k"], ["t"])
    seen = store._Log(spark, path).latest()
    store.upsert(spark.createDataFrame([("a", 2, "y")], schema), path, ["k"], ["t"])
    monkeypatch.setattr(store._Log, "latest", lambda self: seen)
    with pytest.raises(RuntimeError, match="someone else"):
        store.upsert(spark.createDataFrame([("a", 3, "z")], schema), path, ["k"], ["t"])
    monkeypatch.undo()
    assert rows(store.read_table(spark, path)) == [("a", 2, "y")]


def test_many_upserts_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(store.PARTS + 3):
        out = store.upsert(spark.createDataFrame([("a", n, str(n)), (str(n), 0, "own")], "k string, t int, v string"), path, ["k"], ["t"])
    want = sorted([("a", store.PARTS + 2, str(store.PARTS + 2)), *[(str(n), 0, "own") for n in range(store.PARTS + 3)]], key=repr)
    assert rows(out) == rows(store.read_table(spark, path)) == want
    assert store.vacuum(spark, path) == store.PARTS and rows(store.read_table(spark, path)) == want and store.vacuum(spark, path) == 0


def test_runs(spark):
    df = spark.createDataFrame([(1, "a", "r", "old", 5.0, False, AT[0]), (2, "a", "r", "new", 7.0, False, AT[1]), (3, "b", "r", "new", 9.0, True, AT[1]), (4, "z", "r", "new", 9.0, False, AT[1]), (5, "a", "q", None, 1.0, False, AT[3])], SCORES)
    resumes = spark.createDataFrame([("a", "Ann"), ("b", None), ("a", "Ann")], "candidate_id string, candidate_name string")
    out = store.latest_results(df, resumes)
    assert rows(out.select("id", "candidate_name")) == [(2, "Ann"), (3, None)]
    fine, failed = store.ranked_and_excluded(out)
    assert rows(fine.select("id", "place")) == [(2, 2)] and rows(failed.select("id", "place")) == [(3, 1)]
    assert store.in_list_or_all(df, "id", []).count() == 5 and store.in_list_or_all(df, "id", [1]).count() == 1


def test_append_is_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "r", "x", 5.0, False, AT[0])], SCORES)
    store.append_scores(df, str(tmp_path / "s"))
    store.append_scores(df, str(tmp_path / "s"))
    got = store.scores_of_role(spark, str(tmp_path / "s"), "r")
    assert got.count() == 2 and got.columns == df.columns and "role_bucket" in got._jdf.queryExecution().executedPlan().toString()
    run = store.stamped(df.drop("run_id", "scored_at")).first()
    assert len(run["run_id"]) == 36 and run["scored_at"] is not None


def docx(body: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    (tmp_path / "x.docx").write_bytes(docx(p("Skills", "H2") + p("one", "ListBullet") + table + p("end") + p("")))
    (tmp_path / "y.txt").write_text("plain ü", encoding="utf-8")
    (tmp_path / "z.pdf").write_bytes(b"%PDF")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r["path"].rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["x.docx"]["text"] == "## Skills\n- one\n| a | b |\n| --- | --- |\n| 1 | 2 |\nend"
    assert got["y.txt"]["text"] == "plain ü" and got["z.pdf"]["error"].startswith("ValueError") and got["bad.docx"]["error"].startswith("BadZipFile")
    more = {r["path"].rpartition("/")[2]: r["text"] for r in files.read_documents(spark, str(tmp_path), {"pdf": lambda b: (f"{len(b)} bytes", [], "own")}).collect()}
    assert more["z.pdf"] == "4 bytes" and files.scanned(39, 1) and not files.scanned(80, 2)


def test_progress(spark, tmp_path):
    names = spark.createDataFrame([("a.pdf",), ("b.exe",), ("C.DOCX",), (None,)], "file_name string")
    fine, bad = files.accepted(names, "file_name")
    assert fine.count() == 2 and bad.count() == 2
    results = spark.createDataFrame([("a.pdf", "ok", "1", None), ("b.exe", "error", None, "unsupported")], "file_name string, status string, candidate_id string, error string")
    many = spark.range(50).select(F.col("id").cast("string").alias("file_name"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("candidate_id"), F.lit(None).cast("string").alias("error"))
    assert sorted(r["seq"] for r in files.progress_events(many.repartition(7), 50).collect()) == list(range(51))
    lines = [json.loads(r["json"]) for r in files.progress_events(results, 2).orderBy("seq").collect()]
    assert lines[0] == {"type": "meta", "total": 2} and lines[1]["file_name"] == "b.exe" and "error" not in lines[2]
    (tmp_path / "e.ndjson").write_text("\n".join(json.dumps(x) for x in lines[:2]) + "\n{broken\n" + json.dumps(lines[2]))
    counts = files.progress_counts(files.read_ndjson(spark, str(tmp_path / "e.ndjson"), EVENT)).first()
    assert tuple(counts) == (2, 1, 1, 2)


def test_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    line = lambda c, t, s: json.dumps({"candidate_id": c, "uploaded_at": t, "skills": s, "certifications": ["Tools: Go"]})
    (source / "1.json").write_text(line("a", "2025-01-01T00:00:00", ["SQL"]) + "\n{oops\n" + line("b", "2025-01-01T00:00:00", None) + "\n" + json.dumps({"skills": ["x"]}))
    ingest.ingest_stream(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(120)
    (source / "2.json").write_text(line("a", "2025-01-02T00:00:00", ["Rust", "go"]))
    ingest.ingest_stream(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(120)
    got = {r["candidate_id"]: r["skills_all_sources"] for r in store.read_table(spark, target).collect()}
    assert got == {"a": ["Rust", "go"], "b": ["Go"]}


def test_daily_rates(spark):
    df = spark.createDataFrame([(AT[0], "r", 1.0), (AT[0], "r", 3.0), (AT[1], "r", None)], "scored_at timestamp, role_id string, final_score double")
    assert rows(ingest.score_rates(df).select("n", "best")) == [(1, None), (2, 3.0)]
    assert F is not None
