"""Scores, grades and classes of profiles as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.skills import mentioned


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(filled(c), F.trim(c)) for c in columns])


def points(*rules: tuple[Column, int]) -> Column:
    """The sum of the points whose condition holds; an unknown condition gives none."""
    total = F.lit(0)
    for condition, n in rules:
        total = total + F.when(condition, n).otherwise(0)
    return total


def ladder(value: Column, steps: tuple[tuple[int, int], ...], otherwise: int = 0) -> Column:
    """The points of the first threshold that the value reaches; thresholds fall."""
    out = F.lit(otherwise)
    for least, n in reversed(steps):
        out = F.when(value >= least, n).otherwise(out)
    return out


#: Fixed values of the score: points of skills by their number, and grades by the total.
SKILL_STEPS = ((12, 25), (8, 20), (4, 15), (1, 10))
GRADES = ((85, "A+"), (75, "A"), (60, "B"))


def profile_score(p: DataFrame) -> DataFrame:
    """p with contact, completeness, skills_score, experience_score, formatting, overall (0 to 100), grade and strengths.

    p has name, summary, error_message (strings), n_emails, n_phones, n_profiles, n_skills, n_experience, n_education,
    n_projects (numbers), and has_role, has_company, has_dates, has_highlights (booleans).
    """
    words = F.size(F.filter(F.split(F.trim(F.coalesce("name", F.lit(""))), r"\s+"), lambda w: w != ""))
    contact = points((words >= 2, 5), (F.col("n_emails") > 0, 5), (F.col("n_phones") > 0, 3), (F.col("n_profiles") > 0, 2))
    complete = points((F.length(F.trim("summary")) > 30, 5), (F.col("n_skills") >= 3, 5), (F.col("n_experience") > 0, 5), (F.col("n_education") > 0, 5), (F.col("n_projects") > 0, 5))
    done = points((F.col("has_role") & F.col("has_company"), 10), (F.col("has_dates"), 5), (F.col("has_highlights"), 10))
    experience = F.when(F.col("n_experience") > 0, done).when(F.col("n_education") > 0, 15).otherwise(0)
    out = p.withColumns({
        "contact": contact, "completeness": complete, "skills_score": ladder(F.coalesce("n_skills", F.lit(0)), SKILL_STEPS),
        "experience_score": experience, "formatting": F.when(filled(F.col("error_message")), 5).otherwise(10),
    })
    total = F.least(F.greatest(F.col("contact") + F.col("completeness") + F.col("skills_score") + F.col("experience_score") + F.col("formatting"), F.lit(0)), F.lit(100))
    grade = F.lit("C")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("overall") >= least, name).otherwise(grade)
    praise = F.array(
        F.when(F.col("contact") >= 13, "complete contact details"), F.when(F.col("skills_score") >= 20, "many skills"),
        F.when(F.col("experience_score") >= 20, "detailed experience"), F.when(F.col("completeness") >= 20, "complete sections"), F.when(F.col("formatting") == 10, "clean format"),
    )
    return out.withColumn("overall", total).withColumns({"grade": grade, "strengths": F.slice(F.filter(praise, lambda x: x.isNotNull()), 1, 4)})


#: What each part of a profile is praised for, and what is suggested where it is missing, in their order.
PRAISE = {
    "email": "Professional email address detected.", "links": "Professional online profile links (LinkedIn/GitHub) present.", "summary": "Engaging professional summary present.",
    "projects": "Showcases portfolio projects and/or professional certifications.", "many_skills": "Rich technical keyword density with {} recognized skills.", "skills": "Solid skills coverage with {} skills.",
    "highlights": "Structured role bullet points with responsibilities and achievements.", "clean": "Clean document structure with 100% ATS parseability.",
}
ADVICE = {
    "name": "Clearly state your full name prominently at the top of your resume.", "email": "Add a professional email address for recruiter contact.", "phone": "Include a valid contact phone number with country code.",
    "links": "Include a customized LinkedIn or GitHub profile link.", "summary": "Add a 2-3 sentence professional summary highlighting your core expertise.", "skills": "Include a dedicated Technical Skills section.",
    "experience": "Include work experience, internships, or professional projects.", "education": "List your educational degrees and graduating institutions.",
    "projects": "Add key projects or certifications to demonstrate practical expertise.", "few_skills": "Expand your skills section with relevant frameworks, tools, and libraries.",
    "no_skills": "Keywords are essential for ATS matching. Add relevant technical competencies.", "highlights": "Use bullet points with action verbs and quantifiable results in experience.",
    "history": "Detail your work history with job titles, companies, and dates.", "error": "Resolve formatting issue: {}",
}

#: How many of either are shown.
MOST_ADVICE = 4


def advice(p: DataFrame) -> dict[str, Column]:
    """praise and suggestions of a profile with the columns of profile_score(): the first four of each that apply, in order.
    Missing numbers count as 0, missing texts as empty."""
    n = lambda c: F.coalesce(c, F.lit(0))
    words = F.size(F.array_remove(F.split(F.trim(F.coalesce("name", F.lit(""))), r"\s+"), ""))
    summary, error = F.length(F.trim(F.coalesce("summary", F.lit("")))) > 30, filled(F.col("error_message"))
    jobs, told, skills = n("n_experience") > 0, F.coalesce("has_highlights", F.lit(False)), n("n_skills")
    counted = lambda text: F.replace(F.lit(text), F.lit("{}"), skills.cast("string"))
    praise = (
        (n("n_emails") > 0, F.lit(PRAISE["email"])), (n("n_profiles") > 0, F.lit(PRAISE["links"])), (summary, F.lit(PRAISE["summary"])), (n("n_projects") > 0, F.lit(PRAISE["projects"])),
        (skills >= 12, counted(PRAISE["many_skills"])), (skills.between(8, 11), counted(PRAISE["skills"])), (jobs & told, F.lit(PRAISE["highlights"])), (~error, F.lit(PRAISE["clean"])),
    )
    missing = {
        "name": words < 2, "email": n("n_emails") == 0, "phone": n("n_phones") == 0, "links": n("n_profiles") == 0, "summary": ~summary, "skills": skills < 3, "experience": ~jobs, "education": n("n_education") == 0,
        "projects": n("n_projects") == 0, "few_skills": skills.between(1, 3), "no_skills": skills == 0, "highlights": jobs & ~told, "history": ~jobs & (n("n_education") == 0), "error": error,
    }
    text = lambda k: F.replace(F.lit(ADVICE[k]), F.lit("{}"), F.coalesce("error_message", F.lit("")))
    first = lambda rules: F.slice(F.array_compact(F.array(*[F.when(test, what) for test, what in rules])), 1, MOST_ADVICE)
    return {"praise": first(praise), "suggestions": first([(test, text(k)) for k, test in missing.items()])}


def _sum_of(words: Column, weights: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(weights, w), F.lit(0.0)))


def classify(docs: DataFrame, key: str, words: str, taxonomy: dict[str, dict[str, float]], least: float = 2.5) -> DataFrame:
    """key, domain, score: the domain with the largest sum of weights of its terms among the distinct words.

    taxonomy: domain to {term: weight}, in order; ties go to the earlier domain, and below `least` the domain is General.
    The terms are a literal map, so a document is classified where it lies, without a join or a shuffle.
    """
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(t for group in taxonomy.values() for t in group)]).cast("array<string>")
    docs = docs.select(key, F.array_intersect(words, terms).alias("_hits"))  # once; the domains look at these few alone
    distinct = F.col("_hits")
    scored = []
    for at, (name, terms) in enumerate(taxonomy.items()):
        weights = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
        score = _sum_of(distinct, weights)
        scored.append(F.struct(score.alias("score"), F.lit(-at).alias("at"), F.lit(name).alias("domain")))
    best = docs.select(key, F.array_max(F.array(*scored)).alias("best"))
    return best.select(key, F.when(F.col("best.score") >= least, F.col("best.domain")).otherwise("General").alias("domain"), F.col("best.score").alias("score"))


#: Parts of a role's name and the profile that each stands for, the first that fits.
ROLE_PROFILES = (
    ("mechanical|design", "Mechanical"), ("software|developer|frontend|backend", "Software"), ("civil|structural", "Civil"), ("electrical", "Electrical"),
    ("electronics|embedded", "Electronics"), ("data|analyst", "Data Science"), ("account|finance", "Finance"), ("hr|recruiter", "Human Resources"),
    ("sales|business development", "Sales"), ("marketing", "Marketing"), ("quality|qa", "Quality"),
)


def profile_of_role(role: Column) -> Column:
    """The profile that a role's name suggests; General for others and for null."""
    return F.coalesce(*[F.when(F.lower(role).rlike(parts), name) for parts, name in ROLE_PROFILES], F.lit("General"))


#: Points of a hit in skills, past roles, the present role, education, highlights and the summary.
PROFILE_POINTS = {"skills": 3.0, "roles": 5.0, "role": 6.0, "education": 3.5, "highlights": 1.5, "summary": 1.0}


def _holds(equal: tuple[str, ...], parts: tuple[str, ...]) -> Callable[[Column], Column]:
    """Whether a string is one of these or holds one of those."""
    return lambda s: s.isin(*equal) | F.coalesce(*[F.when(F.contains(s, F.lit(t)), True) for t in parts], F.lit(False))


def profile_domain(p: DataFrame, taxonomy: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], boost: tuple[str, tuple[str, ...], str, float] | None = None, least: float = 2.5) -> DataFrame:
    """p with domain and score, by weighted hits of each domain's terms.

    p has skills (array of strings in lower case), role, roles, education, highlights, summary (strings; null: empty).
    taxonomy: domain to (skill terms, terms of roles and degrees), in order; ties go to the earlier one. A skill hits a
    domain once, if it equals a term or holds one of more than 3 letters. boost: (domain, tools, word, points) for one of
    the tools in skills or highlights and the word in a role. Below `least` the role's name decides.
    """
    texts = ("role", "roles", "education", "highlights", "summary")
    every = {c: tuple(dict.fromkeys(t for skill, other in taxonomy.values() for t in ((t for t in skill if len(t) > 3) if c in ("highlights", "summary") else other))) for c in texts}
    own_columns = p.columns
    p = p.withColumns({f"_low_{c}": F.lower(F.coalesce(c, F.lit(""))) for c in texts} | {"_own": F.coalesce("skills", F.array().cast("array<string>"))})
    p = p.withColumns({f"_in_{c}": mentioned(F.col(f"_low_{c}"), every[c]) for c in texts})
    low, own = {c: F.col(f"_low_{c}") for c in texts}, F.col("_own")
    hits = lambda text, terms: F.size(F.array_intersect(f"_in_{text}", F.array(*[F.lit(t) for t in terms]).cast("array<string>"))) * PROFILE_POINTS[text]
    scored = []
    for at, (name, (skill_terms, role_terms)) in enumerate(taxonomy.items()):
        long = tuple(t for t in skill_terms if len(t) > 3)
        score = F.size(F.filter(own, _holds(skill_terms, long))) * PROFILE_POINTS["skills"]
        score = score + sum((hits(c, role_terms) for c in ("roles", "role", "education")), F.lit(0.0)) + sum((hits(c, long) for c in ("highlights", "summary")), F.lit(0.0))
        if boost and boost[0] == name:
            tool = _holds((), boost[1])
            asked = (F.exists(own, tool) | tool(low["highlights"])) & (F.contains(low["role"], F.lit(boost[2])) | F.contains(low["roles"], F.lit(boost[2])))
            score = score + F.when(asked, boost[3]).otherwise(0.0)
        scored.append(F.struct(score.alias("score"), F.lit(-at).alias("at"), F.lit(name).alias("domain")))
    best = p.select(*own_columns, F.array_max(F.array(*scored)).alias("_best"))
    return best.withColumns({"domain": F.when(F.col("_best.score") >= least, F.col("_best.domain")).otherwise(profile_of_role(F.col("role"))), "score": F.col("_best.score")}).drop("_best")
