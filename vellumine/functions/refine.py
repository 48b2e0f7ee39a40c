"""Refinement of a whole profile: an ordered plan of rules, each of which rewrites some columns from what the rules before it
left. A rule may swap two fields, split one, move an item from one array to another, or fill a field from others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import roles as R
from vellumine.functions import text as T
from vellumine.functions.skills import Words, once, stripped

#: Titles before names, notes of recruiters, words of companies and of roles, and what single fields must not hold.
HONORIFICS = r"(?i)^(?:mr|ms|mrs|dr|er|prof)\.?\s+"
RECRUITER_NOTES = r"(?i)\b(?:wa|npu|call\s+later|aug|sep|oct|nov|dec|2024|2025|2026)\b.*$"
COMPANY_PARTS = ("pvt", "ltd", "inc", "corp", "corporation", "technologies", "solutions", "industries", "holdings", "limited", "company")
STATED_COMPANY_PARTS = (*COMPANY_PARTS, "steel", "motors")
ROLE_PARTS = ("engineer", "developer", "manager", "lead", "architect", "analyst", "specialist", "executive", "officer", "trainee", "intern")
NO_SUMMARY = ("@", "|", "pin code", "sector", "phone:", "email:", "details", "what is your", "notice period", "current ctc")
CERTIFICATE_PARTS = ("certified", "certification", "six sigma", "scrum master", "pmp", "itil", "prince2", "aws certified", "azure certified")
NO_CERTIFICATE = (
    "delivered", "owned complete", "defined vehicle", "achieved ₹", "achieved $", "built strong", "successfully integrated", "led full ownership", "b. tech", "b.tech", "m. tech", "m.tech", "b.e.",
    "bachelor", "master", "conferred b.", "degree with first", "electives such as", "institute of technology", "engineering,",
)
NO_LANGUAGE = ("ctc", "salary", "notice", "relocate", "experience", "what is", "reason")
LEAST_HIGHLIGHT = 5

_OPEN_BRACKET, _EDGES = r"[(\[{][^)\]}]*$", r"\s,\-–—()\[\]{}"

Rule = Callable[[Words, dict[str, str]], dict[str, Column]]


def _bare(value: Column) -> Column:
    """A cleaned field without a bracket that never closes and without marks around it; null if nothing is left."""
    return T.let(L.edged(F.regexp_replace(T.clean_field(value), _OPEN_BRACKET, ""), _EDGES), lambda v: F.when(v != "", v))


def _titled_if_lower(value: Column) -> Column:
    return F.when((value == F.lower(value)) & (value != F.upper(value)), T.title_case(value)).otherwise(value)


def name_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    """Without titles and notes; in title case if it was all capitals or none; from the file name if there is none."""
    edges = r"\s.\-_"
    bare = L.edged(F.regexp_replace(F.regexp_replace(T.clean_field(F.col("name")), HONORIFICS, ""), r"[^\p{L}\p{N}_\s.-]", ""), edges)
    bare = T.let(L.edged(F.regexp_replace(bare, RECRUITER_NOTES, ""), edges), lambda v: F.when(v != "", v))
    one_case = lambda v: F.when((v == F.upper(v)) | (v == F.lower(v)), T.title_case(v)).otherwise(v)
    return {"name": F.coalesce(T.let(bare, one_case), F.col("name"), T.name_from_file(F.col("file_name")))}


def role_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    """Without notes in brackets; not a company; else the best of the other evidence."""
    bare = L.edged(F.regexp_replace(R.without_notes(T.clean_field(F.col("role"))), _OPEN_BRACKET, ""), _EDGES)
    good = lambda v: F.when((F.length(v) >= 3) & ~(L.holds(v, STATED_COMPANY_PARTS) & ~L.holds(v, ROLE_PARTS)), T.title_case(v))
    none = F.array().cast("array<string>")
    other = R.primary_role(F.lit(None).cast("string"), F.transform("experience", lambda e: e["role"]), F.lit(None).cast("string"), F.col("summary"), none, F.col("file_name"), F.col("skills"))
    return {"role": F.coalesce(T.let(bare, good), other)}


def summary_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    """No contact or form as a summary; without one, what role, company and skills say."""
    kept = F.when(~L.holds(F.col("summary"), NO_SUMMARY) & (F.trim("summary") != ""), F.col("summary"))
    first = F.get("experience", F.lit(0))
    company = F.when(~L.is_place(first["company"], words), F.concat(F.lit(" at "), first["company"]))
    skills = F.coalesce(F.nullif(F.array_join(F.slice("skills", 1, 5), ", "), F.lit("")), F.lit("industry-standard technologies"))
    made = F.concat(F.lit("Results-driven "), F.coalesce("role", first["role"], F.lit("Professional")), F.coalesce(company, F.lit("")), F.lit(" with strong expertise in "), skills, F.lit("."))
    return {"summary": F.coalesce(kept, F.when((F.size("skills") > 0) | (F.size("experience") > 0), made))}


def _highlight(line: Column) -> Column:
    bare = T.clean_field(F.regexp_replace(line, f"^[{L.BULLETS}\\s]+", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\*{1,3}|\*{1,3}$", ""), r"(?i)^Key Achievements?:?\s*", "")
    return T.let(L.edged(bare, r"\s.\-_*:"), lambda v: F.when(F.length(v) >= LEAST_HIGHLIGHT, F.when(v.rlike("[.!?]$"), v).otherwise(F.concat(v, F.lit(".")))))


def positions_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    """A company in the role's brackets moves out of them; role and company change places where their words say so; highlights
    are sentences."""
    bracket = r"^([^(]+?)\s*\((.*?)\)$"

    def split(e: Column) -> Column:
        both = e["role"].rlike(bracket)
        inner = F.regexp_replace(F.regexp_extract(e["role"], bracket, 2), r"(?i)(?:from\s+)?[0-9]{4}\s*(?:to|till|-|–)\s*(?:[0-9]{4}|present|current|till date).*$", "")
        role = _titled_if_lower(_bare(F.when(both, F.regexp_extract(e["role"], bracket, 1)).otherwise(e["role"])))
        company = T.clean_field(F.coalesce(F.nullif(e["company"], F.lit("")), F.when(both, T.blank_to_null(L.edged(inner, _EDGES)))))
        lines = F.filter(F.transform(e["highlights"], _highlight), lambda h: h.isNotNull())
        return e.withField("role", role).withField("company", company).withField("location", T.clean_field(e["location"])).withField("highlights", lines)

    def placed(e: Column) -> Column:
        wrong = L.holds(e["role"], COMPANY_PARTS) & ~L.holds(e["role"], ROLE_PARTS) & (e["company"].isNull() | L.holds(e["company"], ROLE_PARTS))
        return F.when(wrong, e.withField("role", e["company"]).withField("company", e["role"])).otherwise(e)

    return {"experience": F.transform(F.transform("experience", split), placed)}


def degrees_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    tidy = lambda v: _titled_if_lower(_bare(v))
    return {"education": F.transform("education", lambda e: e.withField("degree", tidy(e["degree"])).withField("institution", tidy(e["institution"])).withField("details", T.clean_field(e["details"])))}


def certificates_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    """Skills that are certificates move to them; certificates that are sentences, degrees, scores or dates go."""
    moved = F.filter("skills", lambda s: L.holds(s, CERTIFICATE_PARTS))
    every = F.concat("certifications", F.array_except(F.array_distinct(moved), F.col("certifications")))
    month = f"(?:{'|'.join(T.MONTHS)}|[0-9]{{4}})"
    bad = lambda c: L.holds(c, NO_CERTIFICATE) | (c.rlike(r"(?i)\b(?:score|percentile|cgpa|gpa)\b") & F.contains(c, F.lit("%"))) | c.rlike(rf"(?i)\b{month}\s*(?:[-–—]|to)+\s*{month}")
    clean = F.filter(F.transform(every, T.clean_field), lambda c: F.coalesce((F.length(c) >= 3) & ~bad(c), F.lit(False)))
    return {"skills": F.filter("skills", lambda s: ~L.holds(s, CERTIFICATE_PARTS)), "certifications": clean}


def skills_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    return {"skills": once(F.transform(F.filter(F.transform("skills", stripped), lambda s: s != ""), lambda s: T.normal_skill(s, aliases)))}


def languages_rule(words: Words, aliases: dict[str, str]) -> dict[str, Column]:
    good = lambda v: (F.length(v) >= 2) & ~L.holds(v, NO_LANGUAGE) & ~v.rlike("[0-9]")
    kept = F.filter(F.transform("languages", T.clean_field), lambda v: F.coalesce(good(v), F.lit(False)))
    return {"languages": F.array_sort(F.array_distinct(F.transform(kept, T.title_case)))}


#: The plan: every rule sees what the rules before it left.
RULES: tuple[Rule, ...] = (name_rule, role_rule, summary_rule, positions_rule, degrees_rule, certificates_rule, skills_rule, languages_rule)


def refined(profiles: DataFrame, words: Words, aliases: dict[str, str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """profiles after all rules, in order; other columns stay.

    It has file_name, name, role, summary, skills, certifications, languages (arrays), experience (role, company, location,
    highlights and more) and education (degree, institution, details and more). Null arrays are empty.
    """
    for c in ("skills", "certifications", "languages", "experience", "education"):
        profiles = profiles.withColumn(c, F.coalesce(c, F.array().cast(profiles.schema[c].dataType)))
    for rule in rules:
        profiles = profiles.withColumns(rule(words, aliases))
    return profiles
