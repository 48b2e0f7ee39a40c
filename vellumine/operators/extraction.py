"""From the raw text of documents to profiles: cleaning, contacts, sections, and what each section says, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import markup, roles, skills
from vellumine.functions import text as T
from vellumine.functions.degrees import held_degrees
from vellumine.functions.positions import held_positions
from vellumine.functions.skills import Words

#: What a line near the top must not hold to be a name.
NO_NAME = r"(?i)\b(?:resume|curriculum|vitae|cv|profile|summary|email|phone|address|contact|page)\b|[@0-9:/|]"
NAME_LINES = 15


def person_name(text: Column, words: Words, fallback: Column | None = None) -> Column:
    """The first of the leading lines with two to five capitalised words that is no role, company, place or header, else the
    fallback. Words that run into each other are parted."""
    rows = F.transform(F.slice(L.text_lines(text), 1, NAME_LINES), lambda x: F.regexp_replace(x, r"(\p{Ll})(\p{Lu})", "$1 $2"))
    headers = tuple(h for hs in markup.SECTIONS.values() for h in hs)
    capital = lambda x: F.forall(F.split(x, r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    good = lambda x: L.n_words(x).between(2, 5) & ~x.rlike(NO_NAME) & capital(x) & ~L.names(x, words.roles) & ~L.names(x, words.companies) & ~L.is_place(x, words) & ~F.lower(x).isin(*headers)
    found = F.get(F.filter(rows, good), F.lit(0))
    return F.coalesce(found, fallback) if fallback is not None else found


def profiles(docs: DataFrame, id_: str, text: str, file_name: str, words: Words, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: id_, name, role, emails, phones, links, linkedin, github, summary, skills, certifications,
    experience and education (arrays of structs, in their order), and sections (a map).

    Texts are cleaned once and cut into sections where they lie. Positions and degrees are read from their sections in the same
    row, so nothing is shuffled or joined. Null and empty texts give a row with what the file name says.
    """
    raw = docs.select(F.col(id_), F.col(file_name).alias("_file"), markup.cleaned_document(F.col(text), words.roles, words.companies).alias("_text"))
    cut = raw.withColumn("sections", markup.sections(F.col("_text")))
    part = lambda name: F.try_element_at("sections", F.lit(name))
    held = F.transform(held_positions(part("experience"), words), lambda p: p.dropFields("number"))
    learnt = held_degrees(part("education"), words, F.col("_text"))
    links = T.profile_links(F.col("_text"))
    found = cut.select(
        id_, "_file", "_text", "sections", person_name(F.col("_text"), words, T.name_from_file(F.col("_file"))).alias("name"), T.emails(F.col("_text")).alias("emails"), T.phones(F.col("_text")).alias("phones"),
        T.links(F.col("_text")).alias("links"), links["linkedin"].alias("linkedin"), links["github"].alias("github"), skills.summary(part("summary"), F.col("_text")).alias("summary"),
        skills.skills(F.col("_text"), part("skills"), words).alias("_skills"), skills.certifications(part("certifications")).alias("certifications"), held.alias("experience"), learnt.alias("education"),
    )
    normal = skills.once(F.transform("_skills", lambda s: T.normal_skill(s, aliases or {"": ""})))
    role = roles.role(F.col("_text"), words, F.col("name"), F.transform("experience", lambda e: e["role"]), F.col("summary"), None, F.col("_file"))
    return found.select(id_, "name", role.alias("role"), "emails", "phones", "links", "linkedin", "github", "summary", normal.alias("skills"), "certifications", "experience", "education", "sections")
