"""Free-entered values mapped to a canonical list, by a prefix-filtered set-similarity join.

Distinct values are reduced to their core, cut into letter pairs, and joined with the list's forms on the rare pairs of
either side only; length and position filters follow, then the exact Jaccard, then a check word by word. The best entry
is kept, values without one are reported as unmatched.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import packed
from ..session import cut, ship, small, spread_small
from .assignment import assign

#: Least Jaccard of letter pairs for the word check to look at a pair at all.
JACCARD = 0.3
UNMATCHED = -1
#: Cores whose findings a worker remembers.
KEPT_CORES = 100_000

# Words that say nothing about which entry is meant.
STOP = "of for and the with in to a an on".split()
VENDORS = "apache microsoft amazon google ms".split()
# What people put around a skill.
SKILL_BEFORE = "experience with|good knowledge of|knowledge of|hands on|basic|advanced|solid|strong|proficient in|familiar with|working knowledge of|expert in"
SKILL_AFTER = r"skills?|expert|advanced|basic|basics|beginner|intermediate|certified|\d+ ?\+? ?(?:yrs?|years?)"
# Words that may follow the name of a tool.
TOOL_TAILS = (
    "lang language programming db rdbms cache containers engine cluster dashboards server desktop framework ceremonies lib library vcs scm "
    "playbooks automation pipelines cloud streams rest webdriver e2e iac dwh macros scripts models modelling practice core processing io js casework tests"
).split()
# Levels and other words around a title.
TITLE_WORDS = (
    "senior sr junior jr lead principal staff chief experienced wanted urgent hiring now i ii iii iv v m f d x w mfd trainee intern head "
    "graduate entry level mid interim freelance permanent remote hybrid onsite"
).split()

# Other names of skills, as public usage has them.
SKILL_ALIASES = {
    "Python": "py, python3", "Java": "core java, j2se, jdk", "JavaScript": "js, ecmascript", "TypeScript": "ts", "C++": "cpp, c plus plus, cplusplus", "C#": "csharp, c sharp",
    "Go": "golang, go lang", "Rust": "rustlang", "R": "gnu r, r language, r programming", "SQL": "structured query language, ansi sql", "PL/SQL": "plsql", "T-SQL": "transact sql",
    "Bash Scripting": "shell scripting, bash scripts", "Visual Basic for Applications": "vba, excel vba", "PostgreSQL": "postgres, pgsql", "Oracle Database": "oracle 19c, oracle",
    "Microsoft SQL Server": "mssql, sql server", "MongoDB": "mongo", "Cassandra": "apache cassandra", "Elasticsearch": "es cluster, elastic", "Snowflake": "snow flake",
    "Google BigQuery": "bq", "Amazon Redshift": "aws redshift", "Apache Spark": "pyspark", "dbt": "data build tool", "Data Modelling": "dimensional data modelling",
    "Data Quality Control": "dq control, dqc", "Data Warehousing": "dwh, data warehouse", "ETL": "extract transform load", "Stream Processing": "streaming data processing",
    "Pandas": "python pandas", "Power BI": "pbi", "Microsoft Excel": "excel 365", "Machine Learning": "maschinelles lernen", "Deep Learning": "dl models",
    "Computer Vision": "cv modelling", "PyTorch": "torch", "scikit-learn": "sklearn", "Recommender Systems": "recommendation systems, recsys", "Statistical Analysis": "statistics",
    "A/B Testing": "split testing", "Kubernetes": "k8s, kube", "CI/CD": "continuous integration, continuous delivery", "Amazon Web Services": "amazon aws",
    "Site Reliability": "sre practice", "Prometheus Monitoring": "prometheus", "CSS3": "css, cascading style sheets", "HTML5": "html", "Microservices": "micro service architecture",
    "Vue.js": "vue", "Node.js": "node", "React": "reactjs", "Angular": "angularjs", "SAP S/4HANA": "s4 hana, s4hana", "SAP ABAP": "abap", "Salesforce Administration": "sfdc admin, salesforce admin",
    "AutoCAD": "acad", "Finite Element Analysis": "finite elements", "PLC Programming": "programmable logic controllers, plc", "HVAC Maintenance": "hvac", "Embedded Systems": "embedded sw",
    "Accounts Payable": "creditor ledger, ap processing", "Accounts Receivable": "debtor ledger, ar processing", "VAT Returns": "value added tax returns, vat filing", "Payroll Processing": "payroll, payroll admin",
    "Bank Reconciliation": "bank recs, reconciliation of bank accounts", "Identity Management": "iam", "Business Analysis": "biz analysis", "Vulnerability Management": "vuln mgmt",
    "Technical Writing": "writing of technical docs", "Test Automation": "automated testing", "Paid Media Buying": "paid media",
    "Manual Testing": "testing manually", "Performance Testing": "perf testing", "Requirements Engineering": "reqs engineering", "REST API Design": "restful api design", "Google Cloud Platform": "google cloud", "Talent Acquisition": "recruiting, recruitment", "Performance Reviews": "appraisals", "Employee Relations": "er casework", "Workforce Planning": "manpower planning",
    "Compensation & Benefits": "comp and ben, total rewards",
    "Agile Delivery": "agile, agile methods", "Scrum": "scrum framework", "Vendor Management": "supplier management", "Lean Six Sigma": "six sigma, 6 sigma, lss",
    "Process Improvement": "process optimisation", "Supply Chain Planning": "scm planning", "Inventory Control": "stock control", "Procurement": "purchasing", "Customer Support": "client support",
    "Regulatory Affairs": "regulatory matters", "Laboratory Techniques": "laboratory methods", "GxP Compliance": "gxp", "Penetration Testing": "pentesting", "Selenium": "selenium webdriver",
}
# Other names of jobs.
TITLE_ALIASES = {
    "DevOps Engineer": "platform engineer", "Site Reliability Engineer": "sre, reliability engineer", "Technical Writer": "documentation writer", "Warehouse Supervisor": "warehouse shift lead, warehouse shift", "Legal Counsel": "in house counsel",
    "UX Designer": "ux design specialist, user experience designer", "Test Automation Engineer": "automation tester", "Laboratory Technician": "lab tech", "Supply Chain Planner": "scm planner",
    "Embedded Software Engineer": "firmware engineer, embedded sw engineer", "Regulatory Affairs Manager": "regulatory mgr", "Executive Assistant": "pa to director", "Mobile Developer": "app developer mobile",
    "Product Owner": "po agile", "Security Analyst": "infosec analyst", "Payroll Specialist": "payroll officer, payroll expert", "Cloud Architect": "cloud solutions architect", "Business Analyst": "ba business, biz analyst",
    "Biostatistician": "biostatistics specialist", "Project Manager": "projektleiter, pm projects", "Support Engineer": "helpdesk engineer, help desk engineer",
    "Recruiter": "talent acquisition specialist, recruitment specialist", "Frontend Developer": "front end developer, ui developer", "Backend Developer": "back end developer", "Full Stack Developer": "fullstack developer",
    "Data Scientist": "data science specialist", "Data Engineer": "dateningenieur", "Penetration Tester": "pentester", "Financial Analyst": "finance analyst",
    "Financial Controller": "controller finance", "Compliance Officer": "compliance specialist", "Learning Designer": "instructional designer", "Accountant": "buchhalter, acct, accounting specialist", "QA Engineer": "quality assurance engineer, quality engineer software", "Database Administrator": "dba, db admin", "Systems Administrator": "sysadmin",
    "Accounts Payable Clerk": "ap clerk, creditor ledger clerk", "HR Business Partner": "hrbp, people partner, human resources business partner", "Tax Adviser": "tax consultant, tax advisor",
}


@dataclass
class Rules:
    """How values of a field are reduced, and the other names of its entries."""

    before: str = ""
    after: str = ""
    tails: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    title: bool = False
    aliases: dict[str, str] = field(default_factory=dict)


SKILLS = Rules(SKILL_BEFORE, SKILL_AFTER, tuple(TOOL_TAILS), (), False, SKILL_ALIASES)
TITLES = Rules("", "", (), tuple(TITLE_WORDS), True, TITLE_ALIASES)


def plain(text: str) -> str:
    """Lower case without accents; separators within words are spaces; signs that belong to names stay."""
    t = unicodedata.normalize("NFKD", text).lower()
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", ""), t + " ")
    t = re.sub(r"(?<=[a-z])\.(?=\s)", " ", t)
    t = re.sub(r"\.(?=js\b)", "", t)
    t = re.sub(r"\.(?=io\b)", " ", t)
    t = re.sub(r"[^a-z0-9+#.Ͱ-￿]+", " ", t)
    return t.strip(" .")


def readings(text: str, rules: Rules) -> list[list[str]]:
    """The readings of a value in groups: a later group counts only where no earlier one means an entry.

    Within a group they go from as typed to most reduced. A title is first what stands before a separator, then any of
    the other parts, then the whole.
    """
    if rules.title:
        t = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
        t = re.sub(r"^\s*[A-Za-z]+\s*:\s*", "", t)
        first, *others = re.split(r"\s[-–/|]\s|,", t)
        return [r for r in (_title_readings(first, rules), [c for o in others for c in _title_readings(o, rules)], _title_readings(t, rules) if others else []) if r]
    t = plain(text)
    out = [t]
    s = re.sub(rf"^(?:(?:{rules.before})\s+)+", "", t)
    s = re.sub(rf"(?:\s+(?:{rules.after}))+$", "", s)
    out.append(s)
    words = s.split()
    while len(words) > 1 and (words[-1] in rules.tails or re.fullmatch(r"\d+(?:\.\d+)*[a-z]?", words[-1])):
        words = words[:-1]
        out.append(" ".join(words))
    if len(words) > 1 and words[0] in VENDORS:
        out.append(" ".join(words[1:]))
    elif len(words) > 1 and words[-1] in VENDORS:
        out.append(" ".join(words[:-1]))
    return [r] if (r := [x for x in dict.fromkeys(out) if x]) else []


def _title_readings(part: str, rules: Rules) -> list[str]:
    words = plain(part).split()
    kept = [w for w in words if w not in rules.drop] or words
    return list(dict.fromkeys(x for x in (" ".join(words), " ".join(kept)) if x))


def forms(entry: str, rules: Rules) -> list[str]:
    """The ways an entry itself is written: as it stands, without its vendor, as initials, by its ends if it is a list, and its other names."""
    base = plain(entry)
    words = base.split()
    out = [base, base.replace(" ", "")]
    if words[0] in VENDORS and len(words) > 1:
        out.append(" ".join(words[1:]))
    core = [w for w in words if w not in STOP]
    if len(core) > 1:
        out.append("".join(w[0] for w in core))
        out.append("".join(w[0] for w in words))
    if "," in entry and len(core) > 2:
        out.append(f"{core[0]} to {core[-1]}")  # a list told by its ends
    out += [plain(a) for a in rules.aliases.get(entry, "").split(",") if a.strip()]
    return [x for x in dict.fromkeys(out) if x]


def pairs(text: str) -> list[str]:
    """The letter pairs of the words, with their beginnings and ends; the words' order does not matter."""
    out = set()
    for w in text.split():
        if w in STOP and len(text) > len(w):
            continue
        w = f"^{w}$"
        out |= {w[i : i + 2] for i in range(len(w) - 1)}
    return sorted(out)


def edits(a: str, b: str, most: int) -> int:
    """Edits between a and b, neighbours swapped being one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            n = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, before[j - 2] + 1)
            row.append(n)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


_ENDS = re.compile(r"(?:ations?|ly|ments?|ings?|ions?|ors?|ers?|ies|ures?|ance|ed|es|al|s|e|y)$")


def _stem(w: str) -> str:
    s = _ENDS.sub("", w)
    s = s if len(s) >= 3 else w
    return s[:-1] if len(s) > 3 and s[-1] == s[-2] else s


def same_word(a: str, b: str) -> float:
    """How surely the word a, as typed, stands for the word b: 0 to 1."""
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if short >= 4 and edits(a, b, 1) == 1 or short >= 3 and (a == b + "s" or b == a + "s"):
        return 0.95
    if short >= 9 and edits(a, b, 2) == 2:
        return 0.9
    if short >= 4 and _stem(a) == _stem(b):
        return 0.9
    if len(a) >= 3 and len(b) >= len(a) + 2 and b.startswith(a):
        return 0.85
    if short >= 6 and edits(_stem(a), _stem(b), 1) <= 1:
        return 0.85
    if 3 <= len(a) <= 5 and len(b) >= len(a) + 3 and a[0] == b[0] and a[-1] in (b[-1], "s"):
        rest = iter(b)
        if all(c in rest for c in a.rstrip("s")) and not re.search(r"[aeiou]", a[1:].rstrip("s")):
            return 0.85
    return 0.0


def _sounded(text: str) -> str:
    """A text with letters of one sound written alike."""
    return re.sub(r"(.)\1+", r"\1", text.replace("ph", "f").replace("ck", "k").replace("th", "t"))


def sureness(a: str, b: str) -> float:
    """How surely the core a means the form b: 0 (not at all) to 1, from edits of the whole and from a word alignment."""
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if x == y:
        return 1.0
    n = min(len(x), len(y))
    most = 1 if n < 11 else 2
    if n >= 4 and (e := edits(x, y, most)) <= most:
        return 0.97 - 0.04 * (e - 1)
    if n >= 6 and x[0] == y[0] and abs(len(x) - len(y)) <= 2 and edits(_sounded(x), _sounded(y), 1) <= 1:
        return 0.93
    left, right = [w for w in a.split() if w not in STOP], [w for w in b.split() if w not in STOP]
    if len(left) != len(right) or len(left) < 2:
        return 0.0
    worth = []
    for w in left:
        worth.append([same_word(w, v) for v in right])
        if not any(worth[-1]):
            return 0.0
    chosen = assign(worth)
    each = [row[j] for row, j in zip(worth, chosen)]
    return 0.95 * sum(each) / len(left) if all(each) else 0.0


def _prefix(n: int) -> int:
    return n - math.ceil(JACCARD * n) + 1


class Index:
    """A block of the list's forms, found by their rare letter pairs."""

    def __init__(self, listed: list[tuple[str, int]], rank: dict[str, int]):
        self.rank, self.listed = rank, listed
        self.told: dict[str, tuple[float, float, int] | None] = {}
        self.sets = [frozenset(rank[p] for p in pairs(f)) for f, _ in listed]
        self.at: dict[int, list[tuple[int, int, int]]] = {}
        for n, held in enumerate(self.sets):
            for place, r in enumerate(sorted(held)[: _prefix(len(held))]):
                self.at.setdefault(r, []).append((n, place, len(held)))

    def near(self, core: str) -> list[tuple[int, float]]:
        """(form, Jaccard) of every form that reaches JACCARD."""
        ps = pairs(core)
        size = len(ps)
        # Pairs the list does not hold come first, as the rarest, and can join nothing.
        held = sorted(r for p in ps if (r := self.rank.get(p)) is not None)
        first = size - len(held)
        seen, out = set(), []
        mine = frozenset(held)
        share = JACCARD / (1 + JACCARD)
        for place, r in enumerate(held[: max(0, _prefix(size) - first)], first):
            for n, there, other in self.at.get(r, ()):
                if n in seen:
                    continue
                seen.add(n)  # the first shared pair has the smallest places of all, so its bound holds for the form
                if size < JACCARD * other or other < JACCARD * size:
                    continue
                if min(size - place, other - there) < share * (size + other) - 1e-9:
                    continue
                shared = len(mine & self.sets[n])
                similarity = shared / (size + other - shared)
                if similarity >= JACCARD:
                    out.append((n, similarity))
        return out

    def surest(self, core: str) -> tuple[float, float, int] | None:
        """(sureness, similarity, -ref_id) of the form that a core means; many values share their cores, so what was found is kept."""
        if core in self.told:
            return self.told[core]
        hits = ((sureness(core, self.listed[f][0]), similarity, -self.listed[f][1]) for f, similarity in self.near(core))
        best = max((h for h in hits if h[0]), default=None)
        if len(core) <= 200:  # long ones do not come twice
            if len(self.told) > KEPT_CORES:
                self.told.clear()
            self.told[core] = best
        return best

    def best(self, value: str, rules: Rules) -> tuple[int, float, float] | None:
        """(ref_id, similarity, sureness) of the entry a value means: the surest, then the least reduced, then the most similar."""
        for group in readings(value, rules):
            hits = [(hit[0], -n, *hit[1:]) for n, core in enumerate(group) if (hit := self.surest(core))]
            if hits:
                sure, _, similarity, minus = max(hits)
                return -minus, similarity, sure
        return None


_BUILT: dict[str, Index] = {}


def built(name: str, block: tuple) -> Index:
    """The index of a block, built once in a worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(*block)
    return _BUILT[name]


#: Forms of the list in one block of the search.
BLOCK = 50_000


def match(values: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """val, ref_id, similarity, sureness of each distinct non-null value of ``values`` (column val); ref_id is -1 for none.

    ``entries`` has the columns ref_id and entry. The list is the query set of the search: it is drawn in blocks of BLOCK
    forms, each held against all values. Of entries that fit equally well the one with the smaller ref_id is kept. An
    empty list leaves all unmatched.
    """
    spark = values.sparkSession
    ship(spark)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, n > 0, i) for i, e in zip(b["ref_id"], b["entry"]) for n, f in enumerate(forms(e, rules))]
            yield pd.DataFrame(rows, columns=["form", "other", "ref_id"])

    listed = entries.where("ref_id is not null and length(trim(entry)) > 0").select(F.col("ref_id").cast("int").alias("ref_id"), "entry").distinct()
    listed = listed.mapInPandas(spell, "form string, other boolean, ref_id int").groupBy("form").agg(F.min(F.struct("other", "ref_id")).alias("x"))
    listed = cut(listed.select("form", "x.ref_id"))
    distinct = cut(spread_small(values.select("val").where("val is not null").distinct()))

    def count(batches: Iterator[pd.DataFrame], of: str, reduced: bool) -> Iterator[pd.DataFrame]:
        often: Counter = Counter()
        for b in batches:
            for v in b[of]:
                told = readings(v, rules) if reduced else [[v]]
                often.update(pairs(told[0][-1]) if told else ())
        yield pd.DataFrame(list(often.items()), columns=["pair", "n"])

    counted = lambda df, of, reduced: df.mapInPandas(lambda b: count(b, of, reduced), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    held = counted(listed, "form", False).select("pair")
    often = held.join(counted(distinct, "val", True), "pair", "left").fillna({"n": 0}).collect()  # at most the letter pairs of the list
    rank = {r["pair"]: i for i, r in enumerate(sorted(often, key=lambda r: (r["n"], r["pair"])))}
    schema = "val string, ref_id int, similarity double, sureness double"
    hits, blocks = spark.createDataFrame([], schema), 0
    rows = listed.orderBy("form").toLocalIterator()
    while block := [(r["form"], r["ref_id"]) for r in islice(rows, BLOCK)]:
        kept, name = spark.sparkContext.broadcast((block, rank)), uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame], kept=kept, name=name) -> Iterator[pd.DataFrame]:
            index = built(name, kept.value)
            for b in batches:
                found = [(v, *hit) for v in b["val"] if (hit := index.best(v, rules))]
                yield pd.DataFrame(found, columns=["val", "ref_id", "similarity", "sureness"])

        hits, blocks = hits.unionByName(distinct.mapInPandas(search, schema)), blocks + 1
    if blocks > 1:
        hits = hits.groupBy("val").agg(F.max(F.struct("sureness", "similarity", (-F.col("ref_id")).alias("minus"))).alias("x"))
        hits = hits.select("val", (-F.col("x.minus")).alias("ref_id"), "x.similarity", "x.sureness")
    return distinct.join(hits, "val", "left").fillna({"ref_id": UNMATCHED})


def map_values(rows: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` (with a column val) and ref_id, similarity, sureness of each, and is_entry where it is an entry letter for letter.

    ``entries`` has the columns ref_id and entry. Every value goes through the search; columns of rows named like the
    added ones are replaced.
    """
    rows = rows.drop("ref_id", "similarity", "sureness", "is_entry")
    exact = entries.where("ref_id is not null and entry is not null").groupBy(F.col("entry").alias("val")).agg(F.min(F.col("ref_id").cast("int")).alias("_exact"))
    book = cut(match(rows, entries, rules).join(small(exact), "val", "left"))
    rows = rows.join(small(book), "val", "left").withColumn("is_entry", F.col("_exact").isNotNull())
    return rows.withColumn("ref_id", F.coalesce("_exact", "ref_id")).drop("_exact")


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """field, record_id, item_no, pos, ref_id of every value that is not an entry as it stands.

    Null lists, null and blank values and null titles give no rows; long ones are looked up whole. Of entries that fit
    equally well the smaller ref_id is kept; with an empty list of entries every value is unmatched (-1). Repeated rows
    count once. Other columns are not read. Empty tables give an empty result.
    """
    skills, titles = tables["skill_ref"].select("ref_id", F.col("skill").alias("entry")), tables["title_ref"].select("ref_id", F.col("title").alias("entry"))
    fields = (("resumes", "candidate_id", "skills"), ("jds", "document_id", "mandatory_skills"))
    values = cut(packed.field_values(tables, skills.select("entry"), fields).select("field", "record_id", "item_no", "pos", "val"))
    typed = tables["jds"].select(F.col("document_id").alias("record_id"), F.regexp_replace("role_title", r"(?U)^\s+|\s+$", "").alias("val"))
    typed = typed.where(F.length("val") > 0).select(F.lit("jds.role_title").alias("field"), "record_id", F.lit(0).alias("item_no"), F.lit(0).alias("pos"), "val")
    out = map_values(values, skills, SKILLS).unionByName(map_values(typed, titles, TITLES))
    return out.where("not is_entry").select("field", "record_id", "item_no", "pos", "ref_id").distinct()
