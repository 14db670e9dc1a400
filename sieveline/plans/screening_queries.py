"""Queries of the screening operators over the project's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions import text as T
from ..functions.dates import utc_text
from ..operators import experience, guards, intervals, matching, percandidate, pipelines, retrieval, scoring, titles
from ..operators.ranks import placed
from ..session import table
from ..sources import files, store
from ..streaming.ingest import score_rates
from .data_queries import AS_OF, _instants

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- parts that several queries share -------------------------------------------------------------


def current_jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_per_key(table(spark, sf_dir, "jds"), ["role_id"], ["uploaded_at", "document_id"])


def people(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "resumes").select("candidate_id", *columns).dropDuplicates(["candidate_id"])


def best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role each candidate scored best in."""
    rows = table(spark, sf_dir, "scores").where("final_score is not null and role_id is not null")
    return rows.groupBy("candidate_id").agg(F.max_by("role_id", F.struct("final_score", "role_id")).alias("role_id"))


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate and role that were scored together and have a resume and a jd, once."""
    rows = table(spark, sf_dir, "scores").select("candidate_id", "role_id").distinct()
    return rows.join(people(spark, sf_dir), "candidate_id", "left_semi").join(table(spark, sf_dir, "jds"), "role_id", "left_semi").select("candidate_id", "role_id")


def requirements(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """The mandatory skills asked of each candidate in the roles of ``pairs``, or in their best role."""
    jds = current_jds(spark, sf_dir).select("role_id", F.explode("mandatory_skills").alias("requirement"))
    have = people(spark, sf_dir).select("candidate_id")
    pairs = best_pairs(spark, sf_dir) if pairs is None else pairs
    return pairs.join(have, "candidate_id").join(jds, "role_id").where("requirement is not null").select("candidate_id", "requirement").distinct()


def asked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role_id, requirements: the mandatory skills of each role."""
    return current_jds(spark, sf_dir).select("role_id", F.filter("mandatory_skills", lambda r: r.isNotNull()).alias("requirements")).where("size(requirements) > 0")


_JDS = "jd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY uploaded_at DESC NULLS LAST, document_id DESC) AS rn FROM jds) WHERE rn = 1)"
_PEOPLE = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id) AS rn FROM resumes) WHERE rn = 1)"
_PAIRS = """best AS (SELECT candidate_id, role_id FROM (SELECT candidate_id, role_id, row_number() OVER (PARTITION BY candidate_id ORDER BY final_score DESC, role_id DESC) AS rn
    FROM scores WHERE final_score IS NOT NULL AND role_id IS NOT NULL) WHERE rn = 1)"""
_REQ = """req AS (SELECT DISTINCT b.candidate_id, r.requirement FROM best b JOIN p ON b.candidate_id = p.candidate_id
    JOIN (SELECT role_id, unnest(mandatory_skills) AS requirement FROM jd) r ON r.role_id = b.role_id WHERE r.requirement IS NOT NULL)"""

_ALL_PAIRS = "best AS (SELECT DISTINCT candidate_id, role_id FROM scores WHERE role_id IN (SELECT role_id FROM jds) AND candidate_id IN (SELECT candidate_id FROM resumes))"


_DISTINCT_SCORES = "s AS (SELECT DISTINCT id, category_scores FROM scores)"
_SUMMED = "0::DOUBLE + " + " + ".join(f"coalesce(category_scores.{c}, 0::DOUBLE)" for c in scoring.CATEGORIES)


def over_all_pairs(name: str) -> str:
    """The SQL of a query of best roles, with all pairs in their place."""
    assert _PAIRS in ORACLE[name]
    return ORACLE[name].replace(_PAIRS, _ALL_PAIRS)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _guard(x: str) -> str:
    return f"regexp_replace(lower({_strip(f'translate(coalesce({x}, $$$$), $$“”‘’–—$$, $$\"\"' + chr(39) * 2 + '--$$)')}), '\\s+', ' ', 'g')"


def _within(text: str, needle: str) -> str:
    return f"(length({needle}) > 0 AND contains({text}, {needle}) AND regexp_matches({text}, '(^|[^a-z0-9])\\Q' || {needle} || '\\E([^a-z0-9]|$)'))"


def _exact(x: str, digits: int = 2) -> str:
    """SQL of round_half_even: the same sums of doubles."""
    fine, scale = f"{10 ** (digits + 1)}::DOUBLE", f"{10**digits}::DOUBLE"
    high = "(abs(v) * 134217729::DOUBLE - (abs(v) * 134217729::DOUBLE - abs(v)))"
    tenths = f"round_even(abs(v) * {fine}, 0)"
    low = f"floor({tenths} / 10::DOUBLE)"
    last = f"({tenths} - {low} * 10::DOUBLE)"
    off = f"(({high} * {fine} - {tenths}) + (abs(v) - {high}) * {fine})"
    up = f"CASE WHEN {last} <> 5 THEN {last} > 5 WHEN {off} <> 0 THEN {off} > 0 ELSE {low} % 2 = 1 END"
    return f"list_transform([{x}], lambda v: sign(v) * ({low} + CASE WHEN {up} THEN 1 ELSE 0 END) / {scale})[1]"


def _cont(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[-_/(),]', ' ', 'g'), '\\s+', ' ', 'g')")


# --- scalar text ----------------------------------------------------------------------------------


@query("""SELECT DISTINCT document_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(role_title, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown-role') AS slug FROM jds""")
def slugify_titles(spark, sf_dir):
    return table(spark, sf_dir, "jds").select("document_id", T.slugify(F.col("role_title")).alias("slug")).distinct()


@query("""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)""")
def doc_tokens(spark, sf_dir):
    t = T.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, md5({_guard('text')}) AS digest FROM documents")
def guard_normalised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.guard_norm(F.col("text"))).alias("digest"))


@query(f"""WITH {_PEOPLE} SELECT candidate_id, CASE WHEN coalesce(candidate_name, '') = '' THEN '?' ELSE
    array_to_string(list_transform(list_slice(regexp_split_to_array({_strip('candidate_name')}, '\\s+'), 1, 2), lambda w: upper(substr(w, 1, 1))), '') END AS initials FROM p""")
def candidate_initials(spark, sf_dir):
    return people(spark, sf_dir, "candidate_name").select("candidate_id", T.initials(F.col("candidate_name")).alias("initials"))


@query(f"""WITH {_PEOPLE} SELECT candidate_id, CASE WHEN len(coalesce(education, [])) = 0 THEN '—' ELSE array_to_string(list_transform(education,
    lambda e: array_to_string(list_filter([e.degree_level, e.field], lambda v: coalesce(v, '') <> ''), ' — ')), ', ') END AS shown FROM p""")
def education_text(spark, sf_dir):
    return people(spark, sf_dir, "education").select("candidate_id", T.format_education(F.col("education")).alias("shown"))


_TIER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(s, '{k}')" for k in keys) + f" THEN '{tier}'" for tier, keys in T.DEGREE_TIERS) + " ELSE 'other' END"


@query(f"""WITH {_PEOPLE}, e AS (SELECT candidate_id, unnest(education).degree_level AS level FROM p), s AS (SELECT candidate_id, level, regexp_replace(lower(coalesce(level, '')), '[^a-z0-9]', '', 'g') AS s FROM e)
    SELECT {_TIER} AS tier, count(*) AS n FROM s GROUP BY 1""")
def degree_tiers(spark, sf_dir):
    rows = people(spark, sf_dir, "education").select(F.explode("education").alias("e"))
    return rows.groupBy(T.degree_tier(F.col("e.degree_level")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_BARE = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\\s]', ' ', 'g')"


@query(f"""WITH {_PEOPLE}, {_JDS}, {_PAIRS},
    er AS (SELECT b.candidate_id, b.role_id, unnest(jd.education_requirements) AS r FROM best b JOIN jd ON jd.role_id = b.role_id JOIN p ON p.candidate_id = b.candidate_id),
    rq AS (SELECT DISTINCT candidate_id, role_id, r.degree_level AS level, r.field AS field, {_strip(_BARE.format('r.field'))} AS f FROM er),
    rt AS (SELECT *, (SELECT {_TIER} FROM (SELECT regexp_replace(lower(coalesce(level, '')), '[^a-z0-9]', '', 'g') AS s)) AS tier FROM rq),
    ed AS (SELECT candidate_id, e.degree_level AS level, {_BARE.format("concat(coalesce(e.degree_level, ''), ' ', coalesce(e.field, ''))")} AS t FROM (SELECT candidate_id, unnest(education) AS e FROM p)),
    et AS (SELECT candidate_id, t, (SELECT {_TIER} FROM (SELECT regexp_replace(lower(coalesce(level, '')), '[^a-z0-9]', '', 'g') AS s)) AS tier FROM ed),
    el AS (SELECT candidate_id, list(t) AS texts, list(tier) AS tiers FROM et GROUP BY 1),
    j AS (SELECT rt.*, coalesce(el.texts, []) AS texts, coalesce(el.tiers, []) AS tiers FROM rt LEFT JOIN el USING (candidate_id)),
    k AS (SELECT *, list_filter(list_transform(regexp_split_to_array(f, '\\bor\\b|\\band\\b'), lambda x: {_strip('x')}), lambda x: length(x) >= 2) AS keys FROM j),
    m AS (SELECT candidate_id, role_id,
        (tier = 'other' OR list_contains(tiers, tier) OR (tier = 'bachelor' AND (list_contains(tiers, 'master') OR list_contains(tiers, 'phd')))) AND
        (f = '' OR contains(f, 'any') OR contains(f, 'related field') OR contains(f, 'relevant field') OR contains(f, 'all fields') OR
         len(list_filter(keys, lambda y: len(list_filter(texts, lambda t: contains(t, y) OR len(list_filter(regexp_split_to_array(y, '\\s+'), lambda w: NOT contains(t, w))) = 0)) > 0)) > 0) AS met FROM k)
    SELECT candidate_id, role_id, count(*) AS n_required, count(*) FILTER (WHERE met) AS n_met FROM m GROUP BY 1, 2""")
def education_fit(spark, sf_dir):
    """Required and met degrees of each candidate in their best role; education_fit_all has every role."""
    return education_met(spark, sf_dir, best_pairs(spark, sf_dir))


@query(over_all_pairs("education_fit"))
def education_fit_all(spark, sf_dir):
    return education_met(spark, sf_dir, all_pairs(spark, sf_dir))


def education_met(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    jds = current_jds(spark, sf_dir).select("role_id", "education_requirements")
    rows = pairs.join(people(spark, sf_dir, "education"), "candidate_id").join(jds, "role_id")
    each = F.explode(F.array_distinct(F.transform("education_requirements", lambda r: F.struct(r["degree_level"].alias("degree_level"), r["field"].alias("field"))))).alias("r")
    rows = rows.select("candidate_id", "role_id", "education", each).withColumn("met", scoring.degree_met(F.col("r"), F.col("education")))
    return rows.groupBy("candidate_id", "role_id").agg(F.count(F.lit(1)).alias("n_required"), F.count_if("met").alias("n_met"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2)
    SELECT vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS cosine FROM x JOIN c USING (label, i) GROUP BY vec_id""")
def cosine_to_centroid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    mean = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return rows.join(mean, "label").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


@query("""WITH q AS (SELECT doc_id, regexp_extract_all(text, '[''‘’][^''‘’]{2,80}[''‘’]|["“”][^"“”]{2,80}["“”]') AS q FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(q) AS n_quotes, array_to_string(list_transform(q, lambda x: regexp_replace(x[2:-2], '^\\s+|\\s+$', '', 'g')), ' | ') AS quotes FROM q WHERE len(q) > 0""")
def quoted_in_documents(spark, sf_dir):
    q = T.quoted_phrases(F.col("text"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", q.alias("q")).where("size(q) > 0")
    return rows.select("doc_id", F.size("q").cast("long").alias("n_quotes"), F.array_join("q", " | ").alias("quotes"))


@query()
def title_ratio(spark, sf_dir):
    """Likeness of each candidate's latest title and the title of every role they were scored for."""
    jds = current_jds(spark, sf_dir).select("role_id", "role_title")
    rows = all_pairs(spark, sf_dir).join(people(spark, sf_dir, "experience"), "candidate_id").join(jds, "role_id")
    rows = rows.select("candidate_id", "role_id", T.containment_norm(F.col("role_title")).alias("a"), T.containment_norm(F.try_element_at("experience", F.lit(1))["title"]).alias("b"))
    ratios = rows.select("a", "b").distinct().withColumn("ratio", T.sequence_ratio("a", "b"))
    return rows.join(ratios, ["a", "b"]).select("candidate_id", "role_id", F.round("ratio", 6).alias("ratio"))


@query(f"""SELECT DISTINCT document_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(role_title, '')), '[a-z0-9]+')), lambda w: NOT list_contains({list(T.TITLE_STOPWORDS)!r}, w))), ' ') AS words,
    {_cont('role_title')} AS plain FROM jds""")
def title_words(spark, sf_dir):
    """The words that count in a title, and the title as it is compared."""
    title = F.col("role_title")
    return table(spark, sf_dir, "jds").select("document_id", F.array_join(F.array_sort(T.word_set(title, T.TITLE_STOPWORDS)), " ").alias("words"), T.containment_norm(title).alias("plain")).distinct()


_MANY = "len(regexp_split_to_array({}, '\\s+')) >= 2"


@query(f"""WITH d AS (SELECT DISTINCT document_id, role_title, 'The evidence states "' || coalesce(role_title, '') || '" and ' || coalesce(responsibilities[1], '') AS reason, coalesce(array_to_string(mandatory_skills, ' | '), '') AS evidence FROM jds),
    q AS (SELECT *, list_transform(regexp_extract_all(reason, '[''‘’][^''‘’]{{2,80}}[''‘’]|["“”][^"“”]{{2,80}}["“”]'), lambda x: {_strip('x[2:-2]')}) AS quoted,
        list_filter(list_transform(regexp_split_to_array(coalesce(role_title, ''), '[—\\-/|]'), lambda x: {_strip('x')}), lambda x: {_MANY.format('x')}) AS parts,
        list_filter([{_strip("coalesce(role_title, '')")}], lambda x: {_MANY.format('x')}) AS whole FROM d),
    w AS (SELECT document_id, list_filter(list_concat(quoted, parts, whole), lambda p: p <> '' AND NOT ({_cont('p')} = '' OR contains({_cont('evidence')}, {_cont('p')})) AND ({_cont('p')} = '' OR contains({_cont('reason')}, {_cont('p')})) AND ({_cont('p')} = '' OR contains({_cont('role_title')}, {_cont('p')})))[1] AS phrase FROM q)
    SELECT document_id, phrase FROM w WHERE phrase IS NOT NULL""")
def false_citations(spark, sf_dir):
    """The phrase that a reason takes from the title though the evidence does not hold it."""
    title = T.text_or_empty(F.col("role_title"))
    reason = F.concat(F.lit('The evidence states "'), title, F.lit('" and '), T.text_or_empty(F.try_element_at("responsibilities", F.lit(1))))
    evidence = F.array_join(L.or_empty(F.col("mandatory_skills")), " | ")
    rows = table(spark, sf_dir, "jds").select("document_id", "role_title", reason.alias("reason"), evidence.alias("evidence")).distinct()
    return rows.select("document_id", T.false_citation(F.col("reason"), F.col("evidence"), F.col("role_title")).alias("phrase")).where("phrase is not null")


@query(f"WITH {_DISTINCT_SCORES} SELECT id, {_exact(_SUMMED)} AS final FROM s")
def final_scores(spark, sf_dir):
    """The final score of the categories, rounded as the exact value is."""
    return table(spark, sf_dir, "scores").select("id", "category_scores").distinct().select("id", scoring.final_score(F.col("category_scores")).alias("final"))


# --- lists ----------------------------------------------------------------------------------------


_TRIMDOT = "regexp_replace({}, '^[ .]+|[ .]+$', '', 'g')"
_PREP = "(?i)\\b(?:for|with|in|of|using|on)\\b"


@query(f"""WITH {_PEOPLE}, i AS (
      SELECT candidate_id, 1 AS part, 0 AS a, generate_subscripts(skills, 1) AS b, unnest(skills) AS s FROM p
      UNION ALL SELECT candidate_id, 2, a, generate_subscripts(x.technologies_used, 1), unnest(x.technologies_used) FROM (SELECT candidate_id, generate_subscripts(experience, 1) AS a, unnest(experience) AS x FROM p)
      UNION ALL SELECT candidate_id, 3, a, generate_subscripts(x.technologies_used, 1), unnest(x.technologies_used) FROM (SELECT candidate_id, generate_subscripts(projects, 1) AS a, unnest(projects) AS x FROM p)
      UNION ALL SELECT candidate_id, 4, a, b, x FROM (SELECT candidate_id, a, b, {_TRIMDOT.format(_strip("regexp_replace(x, '(?i)^(?:and|or)\\s+', '')"))} AS x FROM (
        SELECT candidate_id, a, generate_subscripts(l, 1) AS b, {_TRIMDOT.format(_strip("unnest(l)"))} AS x FROM (
          SELECT candidate_id, a, regexp_split_to_array(regexp_replace(c, '^[^:]*:', ''), '[,&]') AS l FROM (SELECT candidate_id, generate_subscripts(certifications, 1) AS a, unnest(certifications) AS c FROM p) WHERE contains(c, ':'))))
        WHERE x <> '' AND NOT regexp_matches(x, '{_PREP}') AND len(regexp_split_to_array(x, '\\s+')) <= 3),
    k AS (SELECT *, lower({_strip('s')}) AS k FROM i WHERE coalesce({_strip('s')}, '') <> ''),
    f AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, k ORDER BY part, a, b) AS rn FROM k)
    SELECT p.candidate_id, coalesce(string_agg(f.s, '|' ORDER BY part, a, b), '') AS skills FROM p LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON f.candidate_id = p.candidate_id GROUP BY p.candidate_id""")
def skills_of_all_sources(spark, sf_dir):
    rows = people(spark, sf_dir, "skills", "experience", "projects", "certifications")
    return rows.select("candidate_id", F.array_join(L.all_skills(F.col("skills"), F.col("experience"), F.col("projects"), F.col("certifications")), "|").alias("skills"))


_JOBKEY = ", ".join(_guard(f"x.{c}") for c in ("title", "company", "start_date_raw", "end_date_raw", "description"))


@query(f"""WITH {_PEOPLE}, e AS (SELECT candidate_id, unnest(experience) AS x FROM p)
    SELECT p.candidate_id, len(p.experience) AS n_jobs, count(DISTINCT e.k) AS n_kept FROM p JOIN (SELECT candidate_id, concat_ws(chr(1), {_JOBKEY}) AS k FROM e) e ON e.candidate_id = p.candidate_id GROUP BY p.candidate_id, p.experience""")
def deduped_jobs(spark, sf_dir):
    rows = people(spark, sf_dir, "experience").where("size(experience) > 0")
    return rows.select("candidate_id", F.size("experience").cast("long").alias("n_jobs"), F.size(L.dedupe_jobs(F.col("experience"))).cast("long").alias("n_kept"))




@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(regexp_split_to_array(text, '\\r?\\n|\\r'), 1) AS a, {_strip("unnest(regexp_split_to_array(text, '\\r?\\n|\\r'))")} AS line FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, a, regexp_extract(line, '^\\s*([A-Za-z][A-Za-z0-9 &/\\-]{{1,40}}):\\s*(.+)$', 1) AS label, regexp_extract(line, '^\\s*([A-Za-z][A-Za-z0-9 &/\\-]{{1,40}}):\\s*(.+)$', 2) AS rest FROM l),
    s AS (SELECT doc_id, a, rest FROM m WHERE label <> '' AND regexp_matches(label, '{L.SKILL_LABEL}')),
    t AS (SELECT doc_id, a, generate_subscripts(regexp_split_to_array(rest, '[,&]'), 1) AS b, {_TRIMDOT.format(_strip("unnest(regexp_split_to_array(rest, '[,&]'))"))} AS x FROM s),
    u AS (SELECT doc_id, a, b, {_TRIMDOT.format(_strip("regexp_replace(x, '(?i)^(?:and|or)\\s+', '')"))} AS x FROM t),
    v AS (SELECT *, {_guard('x')} AS k FROM u WHERE x <> '' AND NOT regexp_matches(x, '{_PREP}') AND len(regexp_split_to_array(x, '\\s+')) <= 3),
    w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY a, b) AS rn FROM v)
    SELECT doc_id, string_agg(x, '|' ORDER BY a, b) AS tokens FROM w WHERE rn = 1 GROUP BY doc_id""")
def recovered_skills(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", L.labelled_tokens(F.col("text")).alias("t"))
    return rows.where("size(t) > 0").select("doc_id", F.array_join("t", "|").alias("tokens"))


@query("SELECT doc_id, array_to_string(t[2:], '|') AS tokens FROM (SELECT doc_id, string_split(tokens, '|') AS t FROM (" + ORACLE["recovered_skills"] + ")) WHERE len(t) > 1")
def recovered_beyond_the_first(spark, sf_dir):
    """Tokens of labelled lines that are not known, where the first one of a text is."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.slice(L.labelled_tokens(F.col("text")), 1, 1).alias("known"))
    return rows.where("size(known) > 0").select("doc_id", L.recovered(F.col("text"), F.col("known")).alias("t")).where("size(t) > 0").select("doc_id", F.array_join("t", "|").alias("tokens"))


@query(f"""WITH {_JDS} SELECT role_id, array_to_string(list_filter(list_transform(generate_series(1, len(a)), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL), '|') AS pool,
    array_to_string(a[1:3], ' · ') AS top FROM (SELECT role_id, list_filter(list_concat(coalesce(mandatory_skills, []), coalesce(preferred_technical_skills, [])), lambda x: x IS NOT NULL) AS a FROM jd)""")
def matched_views(spark, sf_dir):
    """The pool of two lists of skills, and its first three, as views show them."""
    given = lambda c: F.filter(L.or_empty(F.col(c)), lambda x: x.isNotNull())
    rows = current_jds(spark, sf_dir).select("role_id", given("mandatory_skills").alias("m"), given("preferred_technical_skills").alias("p"))
    return rows.select("role_id", F.array_join(scoring.matched_pool(F.col("m"), F.col("p")), "|").alias("pool"), scoring.top_evidence(F.col("m"), F.col("p")).alias("top"))


_FILL = "(?i)^(?:" + "|".join(L.FILLERS) + ")"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"""WITH r AS (SELECT DISTINCT document_id, list_concat(coalesce(mandatory_skills, []), coalesce(responsibilities, [])) AS items FROM jds),
    l AS (SELECT document_id, generate_subscripts(items, 1) AS a, {_strip("unnest(items)")} AS line FROM r),
    k AS (SELECT document_id, a, {_strip("regexp_replace(" + _strip(f"regexp_replace(line, {_quote(_FILL)}, '')") + ", '\\.+$', '')")} AS core FROM l
        WHERE line <> '' AND NOT regexp_matches(line, {_quote(L.YEARS)}) AND NOT regexp_matches(line, {_quote(L.EDUCATION)}) AND NOT regexp_matches(line, {_quote(L.TOGETHER)})),
    s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(core, '\\.+$', ''), '\\s*,?\\s+(?:and|or)\\s+', ', ', 'g'), ','), lambda x: {_strip('x')}), lambda x: x <> '') AS parts FROM k WHERE core <> ''),
    q AS (SELECT document_id, a, CASE WHEN regexp_matches(core, '(?i)\\b(?:and|or)\\b') AND len(parts) >= 2 AND len(list_filter(parts, lambda x: regexp_matches(x, '{_PREP}'))) = 0 THEN parts ELSE [core] END AS items FROM s),
    u AS (SELECT document_id, a, generate_subscripts(items, 1) AS b, unnest(items) AS x FROM q),
    c AS (SELECT document_id, a, b, {_TRIMDOT.format("regexp_replace(" + _strip(f"regexp_replace({_strip('x')}, {_quote(_FILL)}, '')") + ", '(?i)\\s+skills?\\s*$', '')")} AS x FROM u),
    f AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower({_strip('x')}) ORDER BY a, b) AS rn FROM c WHERE x <> '' AND NOT regexp_matches(x, {_quote(L.PEOPLE)}) AND NOT regexp_matches(x, {_quote(L.HEDGE)}))
    SELECT document_id, string_agg(x, '|' ORDER BY a, b) AS skills FROM f WHERE rn = 1 AND {_strip('x')} <> '' GROUP BY document_id""")
def atomized_requirements(spark, sf_dir):
    rows = table(spark, sf_dir, "jds").select("document_id", F.concat(L.or_empty(F.col("mandatory_skills")), L.or_empty(F.col("responsibilities"))).alias("items")).distinct()
    return rows.select("document_id", L.atomize(F.col("items")).alias("s")).where("size(s) > 0").select("document_id", F.array_join("s", "|").alias("skills"))


@query(f"""WITH {_PEOPLE}, t AS (SELECT candidate_id, generate_subscripts(experience, 1) AS a, {_strip("unnest(experience).title")} AS t FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, lower(t) ORDER BY a) AS rn FROM t WHERE coalesce(t, '') <> '')
    SELECT candidate_id, string_agg(t, '|' ORDER BY a) AS titles FROM f WHERE rn = 1 GROUP BY candidate_id""")
def candidate_titles(spark, sf_dir):
    rows = people(spark, sf_dir, "experience").select("candidate_id", L.titles(F.lit(None).cast("string"), F.col("experience")).alias("t"))
    return rows.where("size(t) > 0").select("candidate_id", F.array_join("t", "|").alias("titles"))


@query(f"""WITH {_PEOPLE}, {_JDS}, {_PAIRS}, {_REQ}, u AS (SELECT candidate_id, list(lower({_strip('requirement')})) AS used FROM req GROUP BY 1)
    SELECT p.candidate_id, len(list_filter(p.skills, lambda s: s IS NOT NULL AND NOT list_contains(u.used, lower({_strip('s')})))) AS n_unused FROM p JOIN u ON u.candidate_id = p.candidate_id WHERE p.skills IS NOT NULL""")
def unused_skills(spark, sf_dir):
    used = requirements(spark, sf_dir).groupBy("candidate_id").agg(F.collect_list("requirement").alias("used"))
    rows = people(spark, sf_dir, "skills").where("skills is not null").join(used, "candidate_id")
    kept = L.unused_skills(F.filter("skills", lambda s: s.isNotNull()), F.col("used"))
    return rows.select("candidate_id", F.size(kept).cast("long").alias("n_unused"))


@query(f"""WITH {_PEOPLE}, {_JDS}, {_ALL_PAIRS}, r AS (SELECT role_id, unnest(mandatory_skills) AS requirement FROM jd), u AS (SELECT role_id, list(lower({_strip('requirement')})) AS used FROM r WHERE requirement IS NOT NULL GROUP BY 1)
    SELECT b.candidate_id, b.role_id, len(list_filter(p.skills, lambda s: s IS NOT NULL AND NOT list_contains(u.used, lower({_strip('s')})))) AS n_unused FROM best b JOIN p ON p.candidate_id = b.candidate_id JOIN u ON u.role_id = b.role_id WHERE p.skills IS NOT NULL""")
def unused_skills_all(spark, sf_dir):
    """Skills that no mandatory requirement of the role names, of each candidate in every role they were scored for."""
    used = current_jds(spark, sf_dir).select("role_id", F.filter("mandatory_skills", lambda s: s.isNotNull()).alias("used")).where("size(used) > 0")
    skills = people(spark, sf_dir, "skills").where("skills is not null").withColumn("skills", F.filter("skills", lambda s: s.isNotNull()))
    rows = all_pairs(spark, sf_dir).join(skills, "candidate_id").join(used, "role_id")
    return rows.select("candidate_id", "role_id", F.size(L.unused_skills(F.col("skills"), F.col("used"))).cast("long").alias("n_unused"))


# --- guards ---------------------------------------------------------------------------------------


@query(f"""WITH {_PEOPLE}, t AS (SELECT candidate_id, {_guard("array_to_string(list_transform(experience, lambda e: e.description), ' ')")} AS t, list_filter(skills, lambda s: s IS NOT NULL) AS skills FROM p WHERE skills IS NOT NULL),
    s AS (SELECT candidate_id, t, {_guard('unnest(skills)')} AS k FROM t),
    w AS (SELECT candidate_id, {_within('t', 'k')} OR (len(string_split(k, ' ')) > 1 AND len(list_filter(string_split(k, ' '), lambda w: NOT {_within('t', 'w')})) = 0) AS ok FROM s WHERE k <> '')
    SELECT candidate_id, count(*) AS n_skills, count(*) FILTER (WHERE ok) AS n_grounded FROM w GROUP BY 1""")
def grounded_skills(spark, sf_dir):
    rows = people(spark, sf_dir, "skills", "experience").where("skills is not null")
    given = F.filter("skills", lambda s: F.length(T.guard_norm(s)) > 0)
    rows = rows.select("candidate_id", given.alias("skills"), F.array_join(F.transform("experience", lambda e: e["description"]), " ").alias("text")).where("size(skills) > 0")
    checked = guards.guard_resume(rows.withColumn("n", F.size("skills")), "text", ("skills",))
    return checked.select("candidate_id", F.col("n").cast("long").alias("n_skills"), F.size("skills").cast("long").alias("n_grounded"))


@query(f"""WITH {_JDS}, t AS (SELECT role_id, min_years_experience AS y, education_requirements AS e, coalesce(array_to_string(responsibilities, ' '), '') AS t FROM jd)
    SELECT role_id, CASE WHEN y > 0 AND NOT regexp_matches(t, {_quote(guards.YEARS_MENTION)}) THEN 0 ELSE y END AS min_years,
    CASE WHEN len(coalesce(e, [])) > 0 AND len(list_filter([{", ".join(repr(w) for w in guards.DEGREE_WORDS)}], lambda w: contains(lower(t), w))) = 0 THEN 0 ELSE len(coalesce(e, [])) END AS n_degrees FROM t""")
def guarded_jds(spark, sf_dir):
    rows = current_jds(spark, sf_dir).withColumn("text", F.array_join(L.or_empty(F.col("responsibilities")), " "))
    out = guards.guard_jd(rows, "text")
    return out.select("role_id", F.col("min_years_experience").alias("min_years"), F.size(F.coalesce("education_requirements", F.array())).cast("long").alias("n_degrees"))


_HEADER = L.COMPANY_DATES.replace("'", "''")


@query(f"""WITH {_PEOPLE}, t AS (SELECT candidate_id, array_to_string(list_transform(experience, lambda e: coalesce(e.company, '') || chr(10) || coalesce(e.start_date_raw, '') || ' - ' || coalesce(e.end_date_raw, '')), chr(10)) AS text, experience[1].company AS first FROM p WHERE experience IS NOT NULL),
    n AS (SELECT candidate_id, first, regexp_replace({_strip("unnest(regexp_extract_all(text, '" + _HEADER + "', 1))")}, '\\s+', ' ', 'g') AS n FROM t),
    k AS (SELECT DISTINCT candidate_id, n FROM n WHERE n <> '' AND len(regexp_split_to_array(n, '\\s+')) <= 6 AND ({_guard('first')} = '' OR NOT (contains({_guard('n')}, {_guard('first')}) OR contains({_guard('first')}, {_guard('n')}))))
    SELECT candidate_id, string_agg(n, '|' ORDER BY n) AS companies FROM k GROUP BY 1""")
def dropped_companies(spark, sf_dir):
    """Companies that head a line of dates in a text made of a resume's jobs, where only the first job's company is known."""
    line = lambda e: F.concat(T.text_or_empty(e["company"]), F.lit("\n"), T.text_or_empty(e["start_date_raw"]), F.lit(" - "), T.text_or_empty(e["end_date_raw"]))
    rows = people(spark, sf_dir, "experience").where("experience is not null").select("candidate_id", F.array_join(F.transform("experience", line), "\n").alias("text"), F.array(F.try_element_at("experience", F.lit(1))["company"]).alias("known"))
    return rows.select("candidate_id", L.dropped_companies(F.col("text"), F.col("known")).alias("c")).where("size(c) > 0").select("candidate_id", F.array_join("c", "|").alias("companies"))


@query(f"""WITH {_PEOPLE}, t AS (SELECT candidate_id, experience[1].title AS title, {_guard("array_to_string(list_transform(experience, lambda e: e.description), ' ')")} AS t FROM p WHERE len(experience) > 0),
    g AS (SELECT *, {_guard('title')} AS k FROM t)
    SELECT candidate_id, CASE WHEN coalesce(title, '') = '' OR {_within('t', 'k')} OR (k <> '' AND len(string_split(k, ' ')) > 1 AND len(list_filter(string_split(k, ' '), lambda w: NOT {_within('t', 'w')})) = 0) THEN coalesce(title, '') ELSE '' END AS title FROM g""")
def guarded_titles(spark, sf_dir):
    """The latest title, where the descriptions bear it out."""
    text = F.array_join(F.transform("experience", lambda e: e["description"]), " ")
    rows = people(spark, sf_dir, "experience").where("size(experience) > 0").select("candidate_id", text.alias("text"), F.try_element_at("experience", F.lit(1))["title"].alias("title"))
    return guards.guard_resume(rows, "text", (), "title").select("candidate_id", F.coalesce("title", F.lit("")).alias("title"))


@query("""SELECT accepted, count(*) AS n FROM (SELECT DISTINCT file_name, coalesce(lower(regexp_extract(file_name, '[.]([^.]+)$', 1)) IN ('pdf', 'docx'), FALSE) AS accepted FROM resumes) GROUP BY 1""")
def accepted_files(spark, sf_dir):
    fine, bad = files.accepted(table(spark, sf_dir, "resumes").select("file_name").distinct(), "file_name")
    return fine.select(F.lit(True).alias("accepted")).unionByName(bad.select(F.lit(False).alias("accepted"))).groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, CASE WHEN coalesce(evidence, '') = '' THEN 'empty' WHEN json_valid(evidence) THEN 'fine' ELSE 'no JSON' END AS state FROM (SELECT DISTINCT id, evidence FROM scores)""")
def salvaged_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "scores").select("id", "evidence").distinct()
    return rows.select("id", F.coalesce(guards.salvage_json(F.col("evidence"), "map<string,string>")["error"], F.lit("fine")).alias("state"))


# --- intervals ------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT AS lo, epoch(greatest(o_orderdate, max(l_shipdate)))::BIGINT AS hi FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate),
    m AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM m)
    SELECT k::VARCHAR AS entity, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY k, i""")
def order_periods(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = orders.join(last, "o_orderkey").select("o_custkey", "o_orderdate", F.greatest("o_orderdate", "shipped").alias("until"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return intervals.merge_intervals(rows.select("o_custkey", seconds("o_orderdate").alias("lo"), seconds("until").alias("hi")), "o_custkey", "lo", "hi").select("entity", "lo", "hi", "n")


@query(f"""WITH {_instants()},
    ja AS (SELECT candidate_id, item_no, max(CASE WHEN side = 'start' AND NOT open THEN u::DATE END) AS lo, max(CASE WHEN side = 'end' THEN CASE WHEN open THEN DATE '{AS_OF}' ELSE u::DATE END END) AS hi FROM i GROUP BY 1, 2),
    jc AS (SELECT candidate_id, count(*) AS n_jobs, count(*) FILTER (WHERE lo IS NULL) AS no_start, count(*) FILTER (WHERE lo IS NOT NULL AND hi IS NULL) AS no_end, count(*) FILTER (WHERE hi < lo) AS rev FROM ja GROUP BY 1),
    jb AS (SELECT *, max(lo) OVER (PARTITION BY candidate_id) AS latest FROM ja WHERE lo IS NOT NULL),
    je AS (SELECT *, count(*) FILTER (WHERE lo = latest AND hi IS NULL) OVER (PARTITION BY candidate_id) AS open FROM jb),
    jh AS (SELECT candidate_id, lo, CASE WHEN hi IS NULL AND lo = latest AND open = 1 THEN DATE '{AS_OF}' ELSE hi END AS hi FROM je),
    jl AS (SELECT candidate_id, lo, least(hi, DATE '{AS_OF}') AS hi FROM jh WHERE hi >= lo AND lo <= DATE '{AS_OF}'),
    jm AS (SELECT *, max(hi) OVER (PARTITION BY candidate_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM jl),
    jy AS (SELECT candidate_id, count(*) AS n_used, sum(greatest(hi - greatest(lo, coalesce(before, lo)), 0)) AS days FROM jm GROUP BY 1),
    jn AS (SELECT DISTINCT candidate_id FROM resumes)
    SELECT n.candidate_id, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_used, 0) AS n_used, round(coalesce(days, 0) / 365.25, 1) AS total_years, concat_ws('; ', CASE WHEN no_start > 0 THEN no_start || ' jobs without a readable start' END,
        CASE WHEN no_end > 0 THEN no_end || ' jobs without a readable end' END, CASE WHEN rev > 0 THEN rev || ' jobs that end before their start' END) AS warnings
    FROM jn AS n LEFT JOIN jc ON jc.candidate_id = n.candidate_id LEFT JOIN jy ON jy.candidate_id = n.candidate_id""")
def total_experience(spark, sf_dir):
    rows = experience.total_years(table(spark, sf_dir, "resumes"), AS_OF)
    return rows.withColumn("warnings", F.array_join("warnings", "; "))


# --- retrieval, matching, roles -------------------------------------------------------------------


@query(f"""WITH {_JDS}, q AS (SELECT DISTINCT title AS query, list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), lambda w: NOT list_contains({list(T.ROLE_STOPWORDS)!r}, w)) AS q FROM title_ref),
    t AS (SELECT role_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(role_title, '')), '[a-z0-9]+')), lambda w: NOT list_contains({list(T.ROLE_STOPWORDS)!r}, w)) AS t FROM jd),
    s AS (SELECT query, role_id, len(list_intersect(q, t)) * 1.0 / (len(q) + len(t) - len(list_intersect(q, t))) AS score FROM q, t WHERE len(list_intersect(q, t)) > 0),
    r AS (SELECT *, row_number() OVER w AS rnk, lead(score) OVER w AS next, count(*) OVER (PARTITION BY query) AS n FROM s WHERE score >= 0.2 WINDOW w AS (PARTITION BY query ORDER BY score DESC, role_id)),
    a AS (SELECT query, max(n) AS n, max(CASE WHEN rnk = 1 THEN score - coalesce(next, 0) END) AS lead, list(role_id ORDER BY rnk) FILTER (WHERE rnk <= 5) AS ids FROM r GROUP BY 1)
    SELECT q.query, CASE WHEN n IS NULL THEN 'no_match' WHEN n = 1 OR lead >= 0.25 THEN 'matched' ELSE 'ambiguous' END AS status,
    CASE WHEN n IS NULL THEN '' WHEN n = 1 OR lead >= 0.25 THEN ids[1] ELSE array_to_string(ids, '|') END AS roles FROM q LEFT JOIN a ON a.query = q.query""")
def resolved_roles(spark, sf_dir):
    out = titles.resolve_roles(table(spark, sf_dir, "title_ref").select(F.col("title").alias("query")), current_jds(spark, sf_dir))
    return out.select("query", "status", F.array_join("role_ids", "|").alias("roles"))


_CHUNKS = f"""pc AS (SELECT candidate_id, 1 AS part, a, trim(concat_ws(' ', nullif(e.description, ''), 'Industry/domain: ' || nullif(e.domain, ''), CASE WHEN len(e.technologies_used) > 0 THEN 'Tools/technologies used: ' || array_to_string(e.technologies_used, ', ') END)) AS text
      FROM (SELECT candidate_id, generate_subscripts(experience, 1) AS a, unnest(experience) AS e FROM p)
    UNION ALL SELECT candidate_id, 2, a, trim(concat_ws(' ', nullif(e.description, ''), CASE WHEN len(e.technologies_used) > 0 THEN 'Tools/technologies used: ' || array_to_string(e.technologies_used, ', ') END))
      FROM (SELECT candidate_id, generate_subscripts(projects, 1) AS a, unnest(projects) AS e FROM p)
    UNION ALL SELECT candidate_id, 3, 1, trim(array_to_string(skills, ', ')) FROM p),
    chunk AS (SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY part, a) - 1 AS chunk_no, text FROM pc WHERE coalesce(text, '') <> '')"""


@query(f"WITH {_PEOPLE}, {_CHUNKS} SELECT candidate_id, chunk_no::INTEGER AS chunk_no, md5(text) AS digest FROM chunk")
def evidence_chunks(spark, sf_dir):
    rows = retrieval.evidence_chunks(people(spark, sf_dir, "experience", "projects", "skills"))
    return rows.select("candidate_id", "chunk_no", F.md5("text").alias("digest"))


@query(f"""WITH {_PEOPLE}, {_JDS}, {_PAIRS}, {_REQ}, {_CHUNKS},
    tk AS (SELECT candidate_id, chunk_no, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunk),
    dl AS (SELECT candidate_id, chunk_no, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM chunk),
    c AS (SELECT candidate_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1),
    tf AS (SELECT candidate_id, chunk_no, term, count(*) AS tf FROM tk GROUP BY 1, 2, 3), df AS (SELECT candidate_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
    qt AS (SELECT candidate_id, requirement, term, count(*) AS qf FROM (SELECT candidate_id, requirement, unnest(regexp_extract_all(lower(requirement), '[a-z0-9]+')) AS term FROM req) GROUP BY 1, 2, 3),
    w AS (SELECT qt.candidate_id, requirement, qt.term, qf * ln((n + 1.0) / df) AS idf, avgdl FROM qt JOIN df USING (candidate_id, term) JOIN c USING (candidate_id)),
    s AS (SELECT w.candidate_id, w.requirement, dl.chunk_no, sum(w.idf * (1 + coalesce(tf.tf * 2.5 / (1.5 * (0.25 + 0.75 * dl.dl / w.avgdl) + tf.tf), 0))) AS score
        FROM w JOIN dl ON dl.candidate_id = w.candidate_id LEFT JOIN tf ON tf.candidate_id = w.candidate_id AND tf.chunk_no = dl.chunk_no AND tf.term = w.term GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, requirement ORDER BY round(score, 9) DESC, chunk_no) AS rnk FROM s)
    SELECT candidate_id, requirement, chunk_no::INTEGER AS chunk_no, rnk::INTEGER AS rnk, round(score, 4) AS score FROM r WHERE rnk <= 3 AND score > 0""")
def bm25_evidence(spark, sf_dir):
    """The best chunks for each mandatory skill of a candidate's best role; bm25_evidence_all has those of every role."""
    return evidence_of(spark, sf_dir, best_pairs(spark, sf_dir))


@query(over_all_pairs("bm25_evidence"))
def bm25_evidence_all(spark, sf_dir):
    return evidence_of(spark, sf_dir, all_pairs(spark, sf_dir))


def evidence_of(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    chunks = people(spark, sf_dir, retrieval.plain_chunks())
    asked = percandidate.requirements_of(pairs, asked_lists(spark, sf_dir))
    return retrieval.best_chunks(asked, chunks).select("candidate_id", "requirement", "chunk_no", "rnk", F.round("score", 4).alias("score"))


_N = lambda x: f"lower({_strip(f'coalesce({x}, $$$$)')})"


@query(f"""WITH {_PEOPLE}, {_JDS}, {_PAIRS}, {_REQ}, v AS (SELECT candidate_id, requirement, {_N('requirement')} AS r, CASE {_N('requirement')} WHEN 'etl' THEN ['etl', 'elt'] WHEN 'elt' THEN ['elt', 'etl'] ELSE [{_N('requirement')}] END AS vs FROM req),
    s AS (SELECT v.*, list_filter(coalesce(p.skills, []), lambda s: {_N('s')} <> '') AS skills FROM v JOIN p ON p.candidate_id = v.candidate_id WHERE r <> '')
    SELECT candidate_id, requirement, coalesce(list_filter(skills, lambda s: list_contains(vs, {_N('s')}))[1],
      list_filter(skills, lambda s: {_within(_N('s'), 'vs[1]')} OR (len(vs) > 1 AND {_within(_N('s'), 'vs[-1]')}) OR (len(regexp_split_to_array({_N('s')}, '\\s+')) > 1 AND {_within('r', _N('s'))}))[1]) AS matched FROM s""")
def exact_skills(spark, sf_dir):
    """The skill that matches each mandatory skill of a candidate's best role; exact_skills_all has those of every role."""
    return exact_of(spark, sf_dir, best_pairs(spark, sf_dir))


@query(over_all_pairs("exact_skills"))
def exact_skills_all(spark, sf_dir):
    return exact_of(spark, sf_dir, all_pairs(spark, sf_dir))


def exact_of(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    lists = asked_lists(spark, sf_dir).withColumn("requirements", F.filter("requirements", lambda r: F.length(T.norm(r)) > 0))
    return matching.exact_by_candidate(percandidate.requirements_of(pairs, lists), people(spark, sf_dir, "skills"))


def _worths(lists: dict[str, str]) -> str:
    """SQL of each asked requirement's worth, worths (candidate_id, requirement, worth), and of who is asked what, asked (candidate_id, role_id, category, pos, requirement)."""
    named = " UNION ALL ".join(f"SELECT role_id, '{c}' AS category, generate_subscripts({column}, 1) AS pos, unnest({column}) AS requirement FROM jd" for c, column in lists.items())
    req = f"asked AS (SELECT b.candidate_id, b.role_id, r.category, r.pos, r.requirement FROM best b JOIN p ON b.candidate_id = p.candidate_id JOIN ({named}) r ON r.role_id = b.role_id WHERE r.requirement IS NOT NULL), req AS (SELECT DISTINCT candidate_id, requirement FROM asked)"
    bm25, exact = ORACLE["bm25_evidence"], ORACLE["exact_skills"]
    parts = bm25[bm25.index("tk AS (") : bm25.index("SELECT candidate_id, requirement, chunk_no::INTEGER")]
    matched = exact[exact.index("v AS (SELECT") :].replace("v AS (", "xv AS (", 1).replace("FROM v JOIN p", "FROM xv v JOIN p").replace(" s AS (SELECT v.*", " xs AS (SELECT v.*").replace("FROM s", "FROM xs")
    split = matched.index("SELECT candidate_id, requirement, coalesce(")
    words = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda w: NOT list_contains(['of', 'and', 'the', 'in', 'for', 'with'], w))"
    return f"""{_PEOPLE}, {_JDS}, {_ALL_PAIRS}, {req}, {_CHUNKS}, {parts},
    {matched[:split].rstrip().rstrip(",")}, ex AS ({matched[split:]}),
    ev AS (SELECT r.candidate_id, r.requirement, list_distinct(flatten(list(regexp_extract_all(lower(chunk.text), '[a-z0-9]+')))) AS held FROM r JOIN chunk ON chunk.candidate_id = r.candidate_id AND chunk.chunk_no = r.chunk_no WHERE r.rnk <= 3 AND r.score > 0 GROUP BY 1, 2),
    sh AS (SELECT q.candidate_id, q.requirement, ex.matched, len(list_intersect({words.format('q.requirement')}, ev.held)) / nullif(len({words.format('q.requirement')}), 0) AS share FROM req q
        LEFT JOIN ex ON ex.candidate_id = q.candidate_id AND ex.requirement = q.requirement LEFT JOIN ev ON ev.candidate_id = q.candidate_id AND ev.requirement = q.requirement),
    worths AS (SELECT candidate_id, requirement, CASE WHEN matched IS NOT NULL THEN 1.0 WHEN share >= 1 THEN 1.0 WHEN share >= 0.6 THEN 0.7 WHEN share > 0.3 THEN 0.35 ELSE 0.0 END::DOUBLE AS worth FROM sh),
    li AS (SELECT a.candidate_id, a.role_id, a.category, list_reduce(list_prepend(0::DOUBLE, list(w.worth ORDER BY a.pos)), lambda x, y: x + y) / count(*) AS average,
        {", ".join(f"coalesce(string_agg(a.requirement, '|' ORDER BY a.pos) FILTER (WHERE w.worth {test}), '') AS {name}" for name, test in (("matched", "> 0"), ("missing", "= 0"), ("gate_missing", "< 0.8")))}, count(*) FILTER (WHERE w.worth < 0.8) AS n_missing
        FROM asked a JOIN worths w ON w.candidate_id = a.candidate_id AND w.requirement = a.requirement GROUP BY 1, 2, 3)"""


@query(f"WITH {_worths({'mandatory_skills': 'mandatory_skills'})} SELECT candidate_id, role_id, round(average, 6) AS average, matched, missing, gate_missing FROM li")
def skill_lists(spark, sf_dir):
    """Matched, missing and gate-missing mandatory skills of each candidate in every role they were scored for."""
    rows = matching.list_scores(all_pairs(spark, sf_dir), asked_lists(spark, sf_dir), people(spark, sf_dir, "experience", "projects", "skills"))
    return rows.select("candidate_id", "role_id", F.round("average", 6).alias("average"), *[F.array_join(c, "|").alias(c) for c in ("matched", "missing", "gate_missing")])


def fit(spark: SparkSession, sf_dir: str, jds: DataFrame) -> DataFrame:
    resumes = people(spark, sf_dir, "experience", "projects", "skills", "education", "total_years_experience")
    out = scoring.job_fit(all_pairs(spark, sf_dir), resumes, jds)
    return out.select("candidate_id", "role_id", "final_score", "hard_gate_failed", *[F.col("category_scores")[c].alias(c) for c in scoring.CATEGORIES])


@query()
def job_fit(spark, sf_dir):
    """The whole score of each candidate in every role they were scored for, with the lexical stand-in as judge."""
    return fit(spark, sf_dir, current_jds(spark, sf_dir))


_CATEGORY = {c: _exact(f"coalesce(max(CASE WHEN li.category = '{c}' THEN li.average END), 1::DOUBLE) * {scoring.WEIGHTS[c]}::DOUBLE * 100") for c in scoring.SKILL_LISTS}


@query(f"""WITH {_worths({c: x for c, x in scoring.SKILL_LISTS.items() if c != "industry_keywords"})}, ef AS ({over_all_pairs("education_fit")}),
    fc AS (SELECT b.candidate_id, b.role_id, {", ".join(f"{x} AS {c}" for c, x in _CATEGORY.items() if c != "industry_keywords")}, 10::DOUBLE AS industry_keywords, 5::DOUBLE AS job_title_match,
        coalesce(max(CASE WHEN li.category = 'mandatory_skills' THEN li.n_missing END), 0) > 6 AS hard_gate_failed FROM best b JOIN p ON p.candidate_id = b.candidate_id LEFT JOIN li ON li.candidate_id = b.candidate_id AND li.role_id = b.role_id GROUP BY 1, 2),
    fd AS (SELECT c.*, CASE WHEN jd.min_years_experience IS NULL OR coalesce(p.total_years_experience, 0) >= jd.min_years_experience THEN 25::DOUBLE ELSE 0::DOUBLE END AS relevant_experience,
        CASE WHEN len(coalesce(jd.education_requirements, [])) = 0 OR ef.n_met > 0 THEN 20::DOUBLE ELSE 0::DOUBLE END AS education
        FROM fc AS c JOIN jd ON jd.role_id = c.role_id JOIN p ON p.candidate_id = c.candidate_id LEFT JOIN ef ON ef.candidate_id = c.candidate_id AND ef.role_id = c.role_id)
    SELECT candidate_id, role_id, {_exact("0::DOUBLE + " + " + ".join(scoring.CATEGORIES))} AS final_score, hard_gate_failed, {", ".join(scoring.CATEGORIES)} FROM fd""")
def job_fit_untitled(spark, sf_dir):
    """job_fit as it is for roles without a title: all but the likeness of titles, which SQL cannot tell."""
    return fit(spark, sf_dir, current_jds(spark, sf_dir).withColumn("role_title", F.lit(None).cast("string")))


_LONGEST = "(SELECT role_title FROM jd WHERE role_title IS NOT NULL ORDER BY length(role_title) DESC, role_title DESC LIMIT 1)"
_ROLE_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda w: NOT list_contains(" + repr(list(T.ROLE_STOPWORDS)) + ", w))"
_RESOLVED = f"""rs AS (SELECT role_id, len(list_intersect(q, t)) * 1.0 / (len(q) + len(t) - len(list_intersect(q, t))) AS score FROM (SELECT role_id, {_ROLE_WORDS.format("coalesce(role_title, '')")} AS t, {_ROLE_WORDS.format(_LONGEST)} AS q FROM jd) WHERE len(list_intersect(q, t)) > 0),
    rr AS (SELECT *, row_number() OVER (ORDER BY score DESC, role_id) AS rnk, lead(score) OVER (ORDER BY score DESC, role_id) AS next, count(*) OVER () AS n FROM rs WHERE score >= 0.2),
    best AS (SELECT p.candidate_id, rr.role_id FROM rr, p WHERE rnk = 1 AND (n = 1 OR score - coalesce(next, 0) >= 0.25))"""


@query(f"""WITH {_worths({"mandatory_skills": "mandatory_skills"}).replace(_ALL_PAIRS, _RESOLVED)}
    SELECT b.candidate_id, b.role_id, {_exact(f"coalesce(li.average, 1::DOUBLE) * {scoring.WEIGHTS['mandatory_skills']}::DOUBLE * 100")} AS mandatory_skills, coalesce(li.n_missing, 0) > 6 AS hard_gate_failed,
        CASE WHEN jd.min_years_experience IS NULL OR coalesce(p.total_years_experience, 0) >= jd.min_years_experience THEN 25::DOUBLE ELSE 0::DOUBLE END AS relevant_experience
    FROM best b JOIN jd ON jd.role_id = b.role_id JOIN p ON p.candidate_id = b.candidate_id LEFT JOIN li ON li.candidate_id = b.candidate_id AND li.role_id = b.role_id""")
def analyze(spark, sf_dir):
    """Every candidate scored for the role that the longest title, as a query, means; without what hangs on likeness of titles."""
    jds = current_jds(spark, sf_dir)
    asked = jds.where("role_title is not null").agg(F.max(F.struct(F.length("role_title"), "role_title"))["role_title"].alias("query"))
    resumes = people(spark, sf_dir, "candidate_name", "experience", "projects", "skills", "education", "total_years_experience")
    _, scores = pipelines.analyze(asked, jds, resumes)
    return scores.select("candidate_id", "role_id", F.col("category_scores.mandatory_skills").alias("mandatory_skills"), "hard_gate_failed", F.col("category_scores.relevant_experience").alias("relevant_experience"))


# --- scores: runs, ranks, views -------------------------------------------------------------------


_DISTINCT = "s AS (SELECT DISTINCT id, candidate_id, role_id, run_id, category_scores, final_score, hard_gate_failed, hard_gate_reason, scored_at FROM scores)"
_LATEST = f"""{_DISTINCT}, lr AS (SELECT role_id, run_id FROM (SELECT role_id, run_id, row_number() OVER (PARTITION BY role_id ORDER BY scored_at DESC NULLS LAST, run_id DESC) AS rn FROM s WHERE run_id IS NOT NULL) WHERE rn = 1),
    n AS (SELECT candidate_id, max(candidate_name) AS candidate_name FROM resumes GROUP BY 1),
    res AS (SELECT s.*, n.candidate_name FROM s JOIN lr ON s.role_id = lr.role_id AND s.run_id = lr.run_id JOIN n ON n.candidate_id = s.candidate_id)"""


def best_first() -> list:
    return [F.col("final_score").desc_nulls_last(), F.coalesce("hard_gate_failed", F.lit(False)).asc(), F.col("candidate_id").asc(), F.col("id").asc()]


def shown(rows: DataFrame) -> DataFrame:
    """rows with uploaded_at as text in UTC, so that no engine's session zone matters."""
    return rows.withColumn("uploaded", utc_text(F.col("uploaded_at"), "yyyy-MM-dd HH:mm:ss")).drop("uploaded_at")


def results(spark, sf_dir):
    rows = table(spark, sf_dir, "scores").drop("evidence").distinct()
    return store.latest_results(rows, table(spark, sf_dir, "resumes"))


@query("SELECT DISTINCT role_id, role_title, department, file_name, strftime(timezone('UTC', uploaded_at), '%Y-%m-%d %H:%M:%S') AS uploaded FROM jds")
def roles_listed(spark, sf_dir):
    return shown(store.list_roles(table(spark, sf_dir, "jds"))).distinct()


@query(f"WITH {_JDS} SELECT role_id, document_id, role_title, strftime(timezone('UTC', uploaded_at), '%Y-%m-%d %H:%M:%S') AS uploaded FROM jd")
def roles_upserted(spark, sf_dir):
    return shown(current_jds(spark, sf_dir).select("role_id", "document_id", "role_title", "uploaded_at"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def wanted_customers(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return store.in_list_or_all(table(spark, sf_dir, "customer"), "c_custkey", keys).select("c_custkey", "c_name")


@query(f"""WITH {_LATEST} SELECT role_id, id, rank() OVER (PARTITION BY role_id ORDER BY final_score DESC NULLS LAST, coalesce(hard_gate_failed, FALSE), candidate_id, id)::INTEGER AS rank,
    CASE WHEN final_score >= 87 THEN 'excellent' WHEN final_score >= 82 THEN 'strong' WHEN final_score >= 72 THEN 'review' ELSE 'low' END AS tier FROM res""")
def ranked_results(spark, sf_dir):
    rows = placed(results(spark, sf_dir).select("role_id", "id", "final_score", "hard_gate_failed", "candidate_id"), "role_id", best_first())
    return rows.select("role_id", "id", "rank", scoring.tier(F.col("final_score")).alias("tier"))


@query(f"""WITH {_LATEST} SELECT role_id, count(*) AS total, count(*) FILTER (WHERE NOT hard_gate_failed) AS passed, count(*) FILTER (WHERE final_score >= 85) AS excellent, count(*) FILTER (WHERE final_score >= 80) AS strong,
    round(avg(final_score), 7) AS average FROM res GROUP BY role_id""")
def run_stats(spark, sf_dir):
    rows = results(spark, sf_dir)
    out = scoring.summary_stats(rows, "role_id").drop("average")
    return out.join(rows.groupBy("role_id").agg(F.round(F.avg("final_score"), 7).alias("average")), "role_id")


@query(f"""WITH {_LATEST} SELECT view, count(*) AS n FROM (SELECT unnest([CASE WHEN TRUE THEN 'all' END, CASE WHEN final_score >= 85 THEN 'excellent' END, CASE WHEN final_score >= 80 THEN 'strong' END, CASE WHEN NOT hard_gate_failed THEN 'mandatory' END]) AS view FROM res)
    WHERE view IS NOT NULL GROUP BY view""")
def view_counts(spark, sf_dir):
    rows = results(spark, sf_dir).select("final_score", "hard_gate_failed")
    out = None
    for view in ("all", "excellent", "strong", "mandatory"):
        part = scoring.filter_view(rows, view).groupBy(F.lit(view).alias("view")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_LATEST}, f AS (SELECT id, unnest([{", ".join(f"{{'field': '{c}', 'value': category_scores.{c}, 'most': {scoring.WEIGHTS[c] * 100:g}}}" for c in scoring.CATEGORIES)}]) AS x FROM res WHERE final_score >= 75)
    SELECT id, x.field AS field, x.value AS value, least(round(x.value / x.most * 100), 100)::INTEGER AS percent FROM f""")
def comparison_rows(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("run_id", F.col("id").cast("string"))
    return scoring.comparison(rows).select(F.col("run_id").cast("long").alias("id"), "field", "value", "percent")


@query(f"""WITH {_DISTINCT} SELECT id, round({" + ".join(f"coalesce(category_scores.{c}, 0)" for c in scoring.CATEGORIES)}, 4) AS total FROM s""")
def category_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "scores").select("id", "category_scores").distinct()
    total = sum((F.coalesce(F.col("category_scores")[c], F.lit(0.0)) for c in scoring.CATEGORIES), F.lit(0.0))
    return rows.select("id", F.round(total, 4).alias("total"))


@query(f"""WITH {_LATEST}, {_PEOPLE}, {_JDS}, r AS (SELECT res.*, jd.role_title, list_filter(coalesce(jd.mandatory_skills, []), lambda s: s IS NOT NULL AND NOT list_contains(list_transform(coalesce(p.skills, []), lambda x: lower({_strip('x')})), lower({_strip('s')}))) AS missing,
        row_number() OVER (PARTITION BY res.role_id ORDER BY final_score DESC NULLS LAST, coalesce(hard_gate_failed, FALSE), res.candidate_id, res.id) AS rank FROM res LEFT JOIN jd ON jd.role_id = res.role_id LEFT JOIN p ON p.candidate_id = res.candidate_id WHERE final_score IS NOT NULL)
    SELECT id, coalesce(nullif(candidate_name, ''), 'This candidate') || ' ranks #' || rank || ' for ' || coalesce(nullif(role_title, ''), 'this role') || ' with a Job Fit score of ' || final_score::DOUBLE || '%.' AS first,
    CASE WHEN hard_gate_failed THEN coalesce(nullif(hard_gate_reason, ''), 'Failed the mandatory-skills hard gate.') WHEN len(missing) = 0 THEN 'All mandatory requirements are satisfied.' ELSE 'Missing ' || len(missing) || ' mandatory skill(s): ' || array_to_string(missing, ', ') || '.' END AS second FROM r""")
def rank_sentences(spark, sf_dir):
    """Why each candidate stands where they do; missing are the mandatory skills of the role that their list does not name."""
    roles = current_jds(spark, sf_dir).select("role_id", "role_title", "mandatory_skills")
    rows = placed(results(spark, sf_dir).where("final_score is not null"), "role_id", best_first()).join(roles, "role_id", "left").join(people(spark, sf_dir, "skills"), "candidate_id", "left")
    missing = L.unused_skills(F.filter("mandatory_skills", lambda s: s.isNotNull()), F.filter("skills", lambda s: s.isNotNull()))
    said = scoring.explain_rank(F.col("candidate_name"), F.col("role_title"), F.col("rank"), F.col("final_score"), F.col("hard_gate_failed"), F.col("hard_gate_reason"), missing)
    return rows.select("id", said[0].alias("first"), said[1].alias("second"))


@query(f"""WITH {_LATEST}, r AS (SELECT role_id, id, candidate_id, row_number() OVER (PARTITION BY role_id ORDER BY final_score DESC NULLS LAST, coalesce(hard_gate_failed, FALSE), candidate_id, id)::INTEGER AS rank, count(*) OVER (PARTITION BY role_id) AS among FROM res)
    SELECT role_id, id, rank, among FROM r WHERE candidate_id = (SELECT min(candidate_id) FROM res)""")
def candidate_places(spark, sf_dir):
    """Where the first candidate stands in each ranking."""
    rows = results(spark, sf_dir)
    first = rows.agg(F.min("candidate_id")).first()[0]
    ranked = placed(rows.select("role_id", "id", "final_score", "hard_gate_failed", "candidate_id"), "role_id", best_first())
    return pipelines.candidate_place(ranked, first).select("role_id", "id", "rank", "among")


@query(f"""SELECT role_id, document_id, role_title FROM (SELECT role_id, document_id, role_title, row_number() OVER (ORDER BY uploaded_at DESC NULLS LAST, document_id DESC) AS rn FROM jds WHERE role_id = (SELECT min(role_id) FROM jds)) WHERE rn = 1""")
def one_role(spark, sf_dir):
    """The latest upload of one role."""
    jds = table(spark, sf_dir, "jds")
    return store.latest_role(jds, jds.agg(F.min("role_id")).first()[0]).select("role_id", "document_id", "role_title")


@query(f"""WITH {_PEOPLE}, {_CHUNKS} SELECT p.candidate_id, md5('Requirement: ' || coalesce(p.experience[1].title, '') || chr(10) || chr(10) || '[' || 'Skills section' || '] ' || trim(array_to_string(p.skills, ', '))) AS digest
    FROM p WHERE length(trim(coalesce(array_to_string(p.skills, ', '), ''))) > 0""")
def judge_prompts(spark, sf_dir):
    """What a judge would be asked about the latest title and the list of skills."""
    chunks = retrieval.evidence_chunks(people(spark, sf_dir, "experience", "projects", "skills")).where("source_type = 'skills'")
    shown = chunks.select("candidate_id", F.array(F.struct("source_label", "text")).alias("evidence"))
    title = T.text_or_empty(F.try_element_at("experience", F.lit(1))["title"])
    return shown.join(people(spark, sf_dir, "experience"), "candidate_id").select("candidate_id", F.md5(matching.judge_prompt(title, F.col("evidence"))).alias("digest"))


@query(f"WITH {_PEOPLE} SELECT candidate_id, experience[1].title AS title, experience[1].company AS company FROM p WHERE len(experience) > 0")
def recent_roles(spark, sf_dir):
    rows = people(spark, sf_dir, "experience").where("size(experience) > 0").select("candidate_id", scoring.recent_role(F.col("experience")).alias("r"))
    return rows.select("candidate_id", "r.title", "r.company")


@query(f"""WITH {_JDS}, d AS (SELECT role_id, min_years_experience AS y, list_filter(list_transform(coalesce(education_requirements, []), lambda e: array_to_string(list_filter([e.degree_level, e.field], lambda v: coalesce(v, '') <> ''), ' in ')), lambda s: s <> '') AS e FROM jd)
    SELECT role_id, array_to_string(list_filter([CASE WHEN y = floor(y) THEN floor(y)::BIGINT::VARCHAR ELSE y::VARCHAR END || '+ yrs experience', nullif(array_to_string(e, ' or '), '')], lambda v: v IS NOT NULL), ' · ') AS line FROM d""")
def jd_lines(spark, sf_dir):
    return current_jds(spark, sf_dir).select("role_id", scoring.jd_summary(F.col("min_years_experience"), F.col("education_requirements")).alias("line"))


@query(f"""WITH {_LATEST}, r AS (SELECT id, coalesce(hard_gate_failed, FALSE) AS excluded, row_number() OVER (PARTITION BY role_id ORDER BY final_score DESC NULLS LAST, candidate_id, id) AS place FROM res) SELECT id, excluded, place::INTEGER AS place FROM r""")
def ranked_and_excluded(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("candidate_id", F.concat_ws(" ", "candidate_id", F.lpad(F.col("id").cast("string"), 20, "0")))
    fine, failed = store.ranked_and_excluded(rows)
    return fine.select("id", F.lit(False).alias("excluded"), "place").unionByName(failed.select("id", F.lit(True).alias("excluded"), "place"))


@query("""WITH e AS (SELECT DISTINCT file_name, candidate_id, CASE WHEN len(coalesce(extraction_warnings, [])) = 0 THEN 'ok' ELSE 'failed' END AS status FROM resumes)
    SELECT count(*) AS done, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed, 0 AS total FROM e""")
def upload_progress(spark, sf_dir):
    status = F.when(F.size(F.coalesce("extraction_warnings", F.array())) == 0, "ok").otherwise("failed")
    rows = table(spark, sf_dir, "resumes").select("file_name", "candidate_id", status.alias("status")).distinct().withColumn("error", F.lit(None).cast("string"))
    events = files.progress_events(rows, 0).select(F.from_json("json", "type string, status string, total int").alias("e")).select("e.*")
    return files.progress_counts(events)


@query("""SELECT DISTINCT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).distinct()


@query("""SELECT strftime(timezone('UTC', scored_at), '%Y-%m-%d') AS day, role_id, count(*) AS n, max(final_score) AS best FROM (SELECT DISTINCT id, scored_at, role_id, final_score FROM scores WHERE scored_at IS NOT NULL) GROUP BY 1, 2""")
def daily_scores(spark, sf_dir):
    rows = score_rates(table(spark, sf_dir, "scores").where("scored_at is not null").select("id", "scored_at", "role_id", "final_score").distinct())
    return rows.select(utc_text(F.col("start"), "yyyy-MM-dd").alias("day"), "role_id", "n", "best")

