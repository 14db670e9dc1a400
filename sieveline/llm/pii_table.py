"""The small labelled table the private-detail model is trained from, as lines with marked slots.

A line is a pattern of what people write; braces stand for slots. Upper-case slots are labelled mentions, lower-case ones
are unlabelled look-alikes. ``labelled`` fills the slots with invented values, always the same for a seed.
"""

from __future__ import annotations

import random

from .names import _GIVEN

KINDS = ("email", "phone", "id_number", "address", "person")

# Labelled lines. {P} person, {U} person in capitals, {R} surname first, {E} email, {T} phone, {I} id with its kind, {A} address.
WITH_DETAILS = """Questions to {P} ({E}).
Contact: {E}
Contact: {E} or {T}
mail {E} or {E}
tel {T}, {E}, {A}
{T} / {T} (evenings)
Reach me on {T} after {n} pm.
Call me under {T} or write to {E}.
Home address {A}.
My address is {A}, phone {T}.
Lived at {A} while on site; mobile {T}.
Invoices went to {A}, later to {A}.
Parcel for {I} holder, drop at {A}
{P}, {A}, {T}
{P}, {A}, {T}
{P}, {A}, {T}
{A}
Mentor: {R}; {E}
Reference: {P}, {T}.
Reference: {P}
Signed: {P}
DATA SHEET {U} {T}
DATA SHEET {U} {T} {T} / {T} (evenings)
{P}, {A}, {T} {T} / {T} (evenings)
Signed: {P} {P}, {A}, {T}
Paired with {P} on the second rollout and ran the demo alone.
Reported to {P} until the move.
Took over from {P} and handed over to {P}.
Site keys kept by {P}, {P} and {P}.
The ward lead, {P}, can be called under {T} or written to at {E}.
Badge request filed under {I} for {P}.
Work permit issued, {I}.
Clearance renewed in {y} ({I}, {I}).
My supervisor {P} approved it in {y}.
Trained by {P}; see also {E}.
Approved by {P} and {P}.
Ask {P} about it, {T}.
Emergency contact {P}, {T}.
Ship it to {A}.
Number on file: {I}.
{P} led the review and {P} took notes.""".splitlines()
# Names as they head a resume, with what may stand beside them.
HEADS = """{P}
{R}
{U}
{P} ({D})
{P} - {D}
{P} | {D}
{P}, {D}
{P}{b}{D}
{R}{b}{D}
{U}{b}{D}
{R} | {D}
{R} ({D})
{R} - {D}
{U} - {D}
{U}, {D}
{P} - Resume v{n}
{P} (CV {y})
{P} | {n} yrs
{P}, MBA""".splitlines()
# Lines without private details.
WITHOUT = """Used {s} for {n} months to support {t} because nobody owned the old scripts.
Used {s} for {n} months to support {t} so that planners could work from one figure.
Handled {n} requests a week about {t} at the {c} site, mostly with {s}.
Trained {n} people in {s} so that shift leads trusted the rota.
Trained {n} people in {s} to free the help desk for harder cases.
My part was {s}: I rebuilt {t} after the merger and kept notes for the night shift.
My part was {s}: I automated {t} over two quarters and kept notes for two contractors.
Together with {g} we retired {t} on short notice; reducing rework by {n} percent was confirmed later.
The hardest task was {t}, which {g} negotiated the supplier terms for in the first winter without stopping deliveries.
Reported weekly on {t} to the {c} office, lowering error rates by {n} percent over {n} weeks.
In {y} I documented {t} with {g}, raising throughput by {n} percent.
Migrated {t} for {f}, then moved on to {s} work in {c}.
Wrote the runbook for {t} for {f}, then moved on to {s} work in {c}.
Tuned {t} during peak season, using {s} and {s}.
Redesigned {t} within six weeks, using {s} and {s}.
Piloted {t} on short notice, using {s} and {s}.
Audited {t} while the vendor was being replaced, using {s} and {s}.
Closed ticket INC-{n}-{n} and order {n}-{n}-{n}.
Opened lanes {n}-{n} on {w} Street terminal floor plan v{n}.
Upgraded from release {n}.{n}.{n} to build {m}.
Wrote the {l} Bridge load study, {n} pages.
Compared {y}-{y} sales, {n}-{n} rows a day.
Moved Plant {n}, Hall {n} to the new layout.
Budget of {n} {n} 000 over {n} years, ISO {n}:{y} certified.
Signed the lease with {l} & {l} {x} for {n} desks.
Posted as @{h} in the team channel, topic #{n}.
Served the {c} road corridor, {n} stops.
Used the {c} and {c} templates on batch {n}-{n}-{n}.
Works with {f} and {f} since {y}.
Mapped the {l} Valley line and the {l} Tower, {n} drawings.
Left {f} when the unit moved to {c}.
Invoice {n}-{m} and part number {n}-{n} were filed under project {w}.
Version {n}.{n} of {s} went live in {c}.""".splitlines()

_STREETS = "Harrowgate Thistle Orchard Millrace Quarry Ferry Foundry Chandler Copper Juniper Saltmarsh Wheatsheaf Larkmoor Bellfounder Ropewalk Mill Church Park High Station".split()
_ENDS = "Road Street Close Ave. St Court Drive Blvd Lane".split()
_GERMAN = "Torwallstr. Mühlenweg Fährstraße Birkenallee Lindengasse Ziegelweg Hauptstr. Gartenweg".split()
_FRENCH = "rue de la Gare,rue de la Tour,rue de la Forge,avenue du Port,rue des Lilas".split(",")
_SKILLS = "T-SQL,PL/SQL,TCP/IP,R,C#,Go,dbt,Git,GxP Compliance,VAT Returns,PLC Programming,HVAC Maintenance,SAP ABAP,REST API Design,Vue.js,CSS3,Market Research,Public Speaking,Microsoft SQL Server,Identity Management,Circuit Design,Python,Java,SQL,Power BI,Visual Basic for Applications,Lean Six Sigma,Machine Learning,Apache Spark,Amazon Web Services,Supply Chain Planning,Data Quality Control,Employee Relations,Regulatory Affairs,Salesforce Administration,Bank Reconciliation,C++,Node.js,SAP S/4HANA,A/B Testing,Key Account Management,Fleet Scheduling,Vendor Management,Hiring, Onboarding and Retention,Compensation & Benefits,Agile Delivery,HTML5,CI/CD".replace("Hiring, ", "Hiring; ").split(",")
# Words that names of skills are made of.
_SKILL_WORDS = (
    "Brand Strategy Oracle Database Google BigQuery Deep Learning Risk Assessment Site Reliability Test Automation Finite Element Analysis Penetration Testing Natural Language Processing Time Series "
    "Forecasting Statistical Modelling Kafka Flink Airflow Hadoop Snowflake Redshift Azure Excel Looker Studio Qlik Sense Tableau Linux Administration Prometheus Monitoring Grafana React Angular Django Spring Boot "
    "GraphQL Microservices Computer Vision Feature Engineering Recommender Systems Stream Docker Kubernetes Terraform Ansible Jenkins Talent Acquisition Payroll Performance Reviews Workforce Demand Inventory Control "
    "Warehouse Operations Procurement Content Marketing Search Engine Optimisation Paid Media Buying Customer Support Internal Audit Financial Business Process Improvement Project Change Stakeholder Contract Negotiation "
    "Technical Writing Laboratory Techniques Clinical Trials Environmental Embedded Requirements Incident Response Vulnerability Manual Scrum Rust Kotlin Scala Pandas Redis Cassandra Elasticsearch Selenium Cypress"
).split()
_THINGS = "the audit trail,an intake form,the booking engine,a fleet tracker,the contact centre queue,an invoice scanner,the member register,a claims archive,the returns portal,a shift rota,the ward planner,the billing ledger,a tender library,the pricing feed,a metering gateway".split(",")
_GROUPS = "the night shift,two contractors,the finance desk,a squad of nine,the platform guild,colleagues in three offices,the lab staff,a product trio,the depot crew".split(",")
_LINES = "Pharma Health Media Foods Energy Logistics Consulting Retail Financial Insurance Manufacturing Engineering Technologies Services Analytics".split()
_FORMS = "AG B.V. plc LLC GmbH Inc Ltd S.A. Group Limited".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given = [g.capitalize() for g in _GIVEN if len(g) > 2]

    def pick(self, of):
        return self.r.choice(of)

    def word(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(["b", "br", "c", "ch", "d", "dr", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "tr", "v", "w", "z"]) + r.choice("aaeeiioouuéöüá") + r.choice(["", "l", "n", "r", "s", "m"]) for _ in range(n))

    def surname(self) -> str:
        s = (self.word(self.r.choice((1, 2, 2))) + self.pick("sen berg man mann ley escu lenko by dahl rani goto lek rand baud netti yan field ham gula bács poulo dikar stone nier ström posch ward lides dez beda boglu zander karo lund lini kost wick nova vasan".split())).capitalize()
        return s + "-" + self.surname() if self.r.random() < 0.06 else s

    def name(self) -> str:
        return self.pick(self.given) if self.r.random() < 0.8 else self.word(2).capitalize()

    def person(self) -> str:
        s, g, x = self.surname(), self.name(), self.r.random()
        if x < 0.5:
            return f"{g} {s}"
        if x < 0.68:
            return f"{g[0]}. {s}"
        if x < 0.82:
            return self.pick(("Mr", "Ms", "Mrs", "Dr.", "Prof.")) + f" {s}"
        if x < 0.95:
            return self.pick(("Dr.", "Mr", "Ms", "Prof.")) + f" {g} {s}"
        return f"{g} {g[0]}. {s}"

    def email(self) -> str:
        r = self.r
        local = self.pick(("{g}.{s}", "{g}_{s}{n}", "{s}{n}", "{i}{s}", "{g}.{s}+cv", "{g}{n}")).format(g=self.name().lower(), s=self.word(2) + self.pick(("sen", "ley", "berg", "by")), i=self.pick("abcdefghjklm"), n=r.randint(1, 99))
        local = local.translate(str.maketrans("éöüáøäß", "eouaoas"))
        host = self.pick(("quickpost", "mailnest", "inboxly", "letterbay", "postbox", "mail", "web", self.word(2).translate(str.maketrans("éöüá", "eoua"))))
        top = self.pick(("example", "invalid", "test", "com", "org", "net"))
        x = r.random()
        if x < 0.62:
            return f"{local}@{host}.{top}"
        if x < 0.7:
            return f"{local}@{host}.{top}".upper()
        if x < 0.8:
            return f"{local.replace('.', ' dot ')} at {host} dot {top}"
        return f"{local}(at){host}(dot){top}" if x < 0.9 else f"{local} [at] {host}.{top}"

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def phone(self) -> str:
        d = self.digits
        area = self.pick(("212", "312", "415", "617", "303", "646"))
        return self.pick(
            (f"+1 {area} 555 {d(4)}", f"{area}-555-{d(4)}", f"({area}) 555-{d(4)}", f"{area}.555.{d(4)}", f"+44 1632 960{d(3)}", f"01632 960 {d(3)}", f"+49 30 23125{d(3)}", f"0049 (0)30 / 23125-{d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"+{d(2)} {d(2)} {d(6)}")
        )

    def identity(self) -> str:
        d = self.digits
        return self.pick(
            (f"SSN {d(3)}-{d(2)}-{d(4)}", f"social security number {d(3)}-{d(2)}-{d(4)}", f"NI number QQ {d(2)} {d(2)} {d(2)} C", f"passport no. X00{d(6)}", f"ID card L0{d(7)}", f"national ID {d(4)} {d(4)} {d(4)}", f"tax ID 00 {d(3)} {d(3)} {d(3)}", f"driving licence ZZ{d(7)}")
        )

    def place(self) -> str:
        return self.pick(("Whitmere", "Corvane", "Oxlode", "Zwieth", "Menth", "Luntz", self.word(2).capitalize(), self.word(2).capitalize()))

    def address(self) -> str:
        n, s, c, x = self.r.randint(1, 240), self.pick(_STREETS), self.place(), self.r.random()
        if x < 0.3:
            return f"{n} {s} {self.pick(_ENDS)}, {c} QZ{self.r.randint(1, 9)} {self.r.randint(1, 9)}XX"
        if x < 0.5:
            return f"{n} {s} {self.pick(_ENDS)} Apt {self.r.randint(1, 40)}, {c}"
        if x < 0.65:
            return f"Flat {self.r.randint(1, 30)}, {n} {s} Court, {c}"
        if x < 0.82:
            return f"{self.pick(_GERMAN)} {n}{self.pick(('', 'a', 'b'))}, 0{self.digits(4)} {c}"
        return f"{n} {self.pick(_FRENCH)}, {c}"

    def skill(self) -> str:
        if self.r.random() < 0.15:
            return self.pick(("R", "C++", "C#", "Go", "dbt", "Git", "SQL", "R"))
        if self.r.random() < 0.4:
            return self.pick(_SKILLS).replace(";", ",")
        return " ".join(self.pick(_SKILL_WORDS) for _ in range(self.r.choice((1, 2, 2, 2, 3))))

    def firm(self) -> str:
        return f"{self.word(3).capitalize()} {self.word(2).capitalize()} {self.pick(_LINES)}" + (f" {self.pick(_FORMS)}" if self.r.random() < 0.3 else "")

    def social(self) -> str:
        """An id whose number alone stands there."""
        return f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"

    def fill(self, line: str) -> list[tuple[str, str]]:
        """(text, kind or '') pieces of a line."""
        out: list[tuple[str, str]] = []
        if "{D}" in line:
            line = line.replace("{D}", self.pick(("{E}", "{T}", "{I}", "{A}")))
        while "{" in line:
            before, _, line = line.partition("{")
            slot, _, line = line.partition("}")
            out.append((before, ""))
            out.append(self.slot(slot))
        return [*out, (line, "")]

    def slot(self, slot: str) -> tuple[str, str]:
        r = self.r
        if slot in "PUR":
            text = self.person()
            if slot == "U":
                text = f"{self.name()} {self.surname()}".upper()
            if slot == "R":
                text = f"{self.surname()}, {self.name()}"
                if r.random() < 0.2:
                    text = f"{self.surname().upper()}, {self.name()[0]}."
            return text, "person"
        if slot == "I":
            return (self.social() if r.random() < 0.12 else self.identity()), "id_number"
        if slot in "ETA":
            return {"E": (self.email, "email"), "T": (self.phone, "phone"), "A": (self.address, "address")}[slot][0](), {"E": "email", "T": "phone", "A": "address"}[slot]
        n = r.randint(1, 10 ** r.randint(1, 4))
        return {
            "n": str(n), "m": str(r.randint(10**5, 10**8)), "y": str(r.randint(1998, 2025)), "s": self.skill(), "t": self.pick(_THINGS), "c": self.place(), "g": self.pick(_GROUPS), "f": self.firm(),
            "b": "\n", "l": self.surname(), "w": self.pick(_STREETS), "x": self.pick(_FORMS), "h": self.pick(("oncall", "release", "dataops", "infra")),
        }[slot], ""


def labelled(texts: int = 6_000, seed: int = 11, part: int | None = None) -> list[list[tuple[str, str]]]:
    """Texts as pieces with their kind ('' for none): lines put together as descriptions are, and heads of resumes.

    With ``part`` only every second line of the table is used, from 0 or from 1, so that one half can be learnt from and
    the other be read as writing that was not seen.
    """
    maker = _Maker(seed)
    heads, details, plain = ([x for n, x in enumerate(dict.fromkeys(lines)) if n % 2 == part] if part is not None else lines for lines in (HEADS, WITH_DETAILS, WITHOUT))
    out = []
    for n in range(texts):
        if n % 5 == 0:
            out.append(maker.fill(maker.pick(heads)))
            continue
        lines = [maker.pick(details if maker.r.random() < 0.6 else plain) for _ in range(maker.r.randint(1, 4))]
        gap = maker.pick((" ", " ", "\n"))
        pieces: list[tuple[str, str]] = []
        for line in lines:
            pieces += [*maker.fill(line), (gap, "")]
        out.append(pieces[:-1])
    return out
