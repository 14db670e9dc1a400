"""Schemas of the records this library reads and writes."""

JOB = "struct<title:string,company:string,start_date_raw:string,end_date_raw:string,domain:string,description:string,technologies_used:array<string>>"
DEGREE = "struct<degree_level:string,field:string,institution:string>"
PROJECT = "struct<title:string,description:string,technologies_used:array<string>>"
REQUIREMENT = "struct<degree_level:string,field:string,required:boolean>"
CATEGORIES = ("mandatory_skills", "relevant_experience", "job_title_match", "industry_keywords", "soft_skills", "preferred_skills", "education")

JD = (
    "role_id string, document_id string, role_title string, department string, mandatory_skills array<string>, preferred_technical_skills array<string>, soft_preferred_skills array<string>, "
    f"industry_keywords array<string>, min_years_experience double, education_requirements array<{REQUIREMENT}>, relevant_certifications array<string>, responsibilities array<string>, "
    "file_name string, extraction_method string, extraction_warnings array<string>, uploaded_at timestamp"
)
RESUME = (
    "candidate_id string, document_id string, candidate_name string, current_role_title_from_summary string, stated_years_experience_from_summary double, total_years_experience double, "
    f"skills array<string>, skills_all_sources array<string>, experience array<{JOB}>, education array<{DEGREE}>, certifications array<string>, projects array<{PROJECT}>, "
    "file_name string, extraction_method string, extraction_warnings array<string>, uploaded_at timestamp"
)
SCORE = (
    f"candidate_id string, role_id string, run_id string, category_scores struct<{','.join(c + ':double' for c in CATEGORIES)}>, evidence string, "
    "final_score double, hard_gate_failed boolean, hard_gate_reason string, scored_at timestamp"
)
#: What a model's JSON for a resume and for a job description holds.
RESUME_OUTPUT = (
    "candidate_name string, current_role_title_from_summary string, stated_years_experience_from_summary double, skills array<string>, "
    f"experience array<{JOB}>, education array<{DEGREE}>, certifications array<string>, projects array<{PROJECT}>"
)
JD_OUTPUT = (
    "role_title string, department string, mandatory_skills array<string>, preferred_technical_skills array<string>, soft_preferred_skills array<string>, industry_keywords array<string>, "
    f"min_years_experience double, education_requirements array<{REQUIREMENT}>, relevant_certifications array<string>, responsibilities array<string>"
)
EVENT = "type string, file_name string, status string, candidate_id string, error string, total int"
