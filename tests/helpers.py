from pyspark.sql import functions as F


def one(spark, column, **values):
    """The value of a column expression over one row of literals (name=(value, type))."""
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items()) or "x int"
    row = tuple(v for v, _ in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


RESUME = (
    "candidate_id string, document_id string, candidate_name string, skills array<string>, total_years_experience double, "
    "experience array<struct<title:string,company:string,start_date_raw:string,end_date_raw:string,domain:string,description:string,technologies_used:array<string>>>, "
    "education array<struct<degree_level:string,field:string,institution:string>>, certifications array<string>, "
    "projects array<struct<title:string,description:string,technologies_used:array<string>>>, office_zone string, jobs string, raw string, val string, pos string, field string, x string"
)


def resume(cid, name=None, skills=None, total=None, experience=None, education=None, projects=None, zone=None):
    """A resume with extra columns whose names the operators use inside."""
    return (cid, None, name, skills, total, experience, education, None, projects, zone, "clash", "clash", "clash", "clash", "clash", "clash")


def job(start=None, end=None, company=None, title=None, description=None, tools=None, domain=None):
    return (title, company, start, end, domain, description, tools)


def resumes(spark, *items):
    return spark.createDataFrame(list(items), RESUME)


__all__ = ["F", "RESUME", "job", "one", "resume", "resumes", "rows"]
