"""Skills, certificates, summaries and links of profiles as column expressions; word lists are parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions import text as T

#: Marks around an item, what parts items, labels in front of them.
MARKS = "•*\\- \\t,;|\uf0b7"
ITEM_BREAKS = "[,;|•\uf0b7]|\\s+-\\s+"
LABEL = r"^(?:[A-Za-z\s/&]+|[0-9]+[.)])\s*:\s*"
SKILL_LINE = (
    r"(?i)^(?:Technical\s+Skills|Core\s+Competencies|Key\s+Skills|Technologies|Tech\s+Stack|Tools|Skillset|Programming\s+Languages|Frameworks|Databases|Cloud|Platforms|Libraries)[\s:]+(.*)"
)
#: Headings that are no skills, parts of roles, names of companies, and words of dates.
HEADINGS = ("software/language", "proficiency", "proficiencies", "technical skills", "skills", "key skills", "languages", "tools", "language")
ROLE_PARTS = ("manager", "engineer", "analyst", "specialist", "developer", "lead", "officer", "trainee", "consultant")
COMPANY_MARKS = ("ltd", "pvt", "limited", "corp", "inc", "technologies", "industries", "solutions", "india", "bridgestone", "wipro")
DATE_WORDS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "present", "current")
CERTIFICATE_HEADINGS = ("certifications", "certificates", "courses", "achievements")
PORTFOLIO_MARKS = ("portfolio", "github.io", "vercel.app", "netlify.app", "me.")


@dataclass(frozen=True)
class Words:
    """Word lists in lower case: known skills, words that are none, words of roles, of companies and of places."""

    known: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    places: tuple[str, ...] = ()


def stripped(value: Column) -> Column:
    """Without white space around it (one argument only: a second one would be the index that F.transform gives)."""
    return F.btrim(value, F.lit(T.WHITE))


def unmarked(value: Column) -> Column:
    """Without white space, bullets and commas around it."""
    return F.regexp_replace(value, f"^[{MARKS}]+|[{MARKS}]+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def whole_word(words: tuple[str, ...]) -> str:
    """A pattern for any of the words between characters of no word, the same in every regex dialect."""
    quoted = "|".join("".join(c if c.isalnum() or c in " _" else f"[{c}]" for c in w) for w in words)
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{quoted})(?:$|[^\p{{L}}\p{{N}}_])"


def _literals(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def once(items: Column) -> Column:
    """The items without later ones that equal an earlier one but for case, in order."""
    return T.first_of_each(F.transform(items, lambda x: F.struct(F.lower(x).alias("key"), x.alias("item"))))


def valid_skill(skill: Column, words: Words) -> Column:
    """Whether this is a skill: 2 to 40 characters with a letter, at most 4 words, no stop word, role, company or date.

    Known skills need only the first three of these. Null is none.
    """

    def judged(s: Column, low: Column) -> Column:
        tokens = F.array_remove(F.split(low, r"\s+"), "")
        stop = low.isin(*words.stop, *HEADINGS) | (F.endswith(low, F.lit("s")) & F.substring(low, F.lit(1), F.length(low) - 1).isin(*words.stop, ""))
        shape = F.length(low).between(2, 40) & ~stop & low.rlike(r"\p{L}") & (F.size(tokens) <= 4)
        holds = lambda parts: low.rlike("|".join(parts))
        companies = tuple(w for w in words.companies if w not in ("systems", "services", "electric"))
        bad = T.let(tokens, lambda t: F.arrays_overlap(t, _literals(words.roles)) | F.arrays_overlap(t, _literals(companies)))
        bad = bad | holds(ROLE_PARTS) | low.rlike(whole_word(COMPANY_MARKS)) | holds(DATE_WORDS) | low.rlike(r"(?:^|[^\p{L}\p{N}_])(?:19|20)[0-9]{2}(?:$|[^\p{L}\p{N}_])")
        return F.coalesce((s == "Go") | (low == "golang") | (shape & (low.isin(*words.known, "") | ~bad)), F.lit(False))

    return T.let(stripped(skill), lambda s: T.let(F.lower(s), lambda low: judged(s, low)))


def mentioned(low: Column, terms: tuple[str, ...]) -> Column:
    """The terms that a text in lower case holds as whole words, in the order of the terms.

    The text is cut into words once, and the terms of one word are those of its words that the list has, whatever the length
    of the list; only terms with blanks or marks in them are searched for one by one.
    """
    single = tuple(t for t in terms if re.fullmatch("[A-Za-z0-9_]+", t))
    found = F.array_intersect(F.split(low, r"[^\p{L}\p{N}_]+"), _literals(single))
    others = {t: low.rlike(whole_word((t,))) for t in terms if t not in single}
    among = lambda present: F.filter(_literals(terms), lambda t: F.coalesce(F.array_contains(present, t), F.lit(False)))
    if others:
        found = F.concat(found, F.array_compact(F.array(*[F.when(hit, F.lit(t)) for t, hit in others.items()])))
    return T.let(found, among)


def _parted(item: Column) -> Column:
    """What an item's parentheses list, then what stands outside of them."""
    bare = unmarked(item)
    inner = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(r"\((.*?)\)"), F.lit(1)), lambda p: F.transform(F.split(p, "[,;/|•]"), stripped)))
    return F.concat(inner, F.array(stripped(F.regexp_replace(bare, r"\(.*?\)", ""))))


def _items(lines: Column, words: Words) -> Column:
    found = F.flatten(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ITEM_BREAKS))), _parted))
    return F.filter(F.array_distinct(found), lambda x: valid_skill(x, words))


def skills(text: Column, section: Column, words: Words) -> Column:
    """Skills of a profile, once each in any case: the section's items; if those are fewer than 3, also the items of
    labelled lines of the text; then the known skills that the text mentions, in title case. Nulls count as empty."""
    text, section = F.coalesce(text, F.lit("")), F.coalesce(section, F.lit(""))
    rows = F.filter(F.transform(lines_of(section), lambda x: unmarked(x)), lambda x: (x != "") & (F.length(x) <= 2500))
    listed = once(_items(F.transform(rows, lambda x: F.coalesce(F.nullif(stripped(F.regexp_replace(x, LABEL, "")), F.lit("")), x)), words))
    short = F.filter(F.transform(lines_of(text), lambda x: unmarked(x)), lambda x: (F.length(x) <= 160) & x.rlike(SKILL_LINE))
    labelled = _items(F.transform(short, lambda x: F.regexp_extract(x, SKILL_LINE, 1)), words)
    known = F.create_map(*[F.lit(x) for k in words.known for x in (k, k.title())]) if words.known else F.map_from_arrays(_literals(()), _literals(()))
    named = F.filter(F.transform(mentioned(F.lower(text), words.known), lambda k: F.element_at(known, k)), lambda x: valid_skill(x, words))
    return once(F.concat(T.let(listed, lambda a: F.when(F.size(a) < 3, F.concat(a, labelled)).otherwise(a)), named))


def certifications(section: Column) -> Column:
    """The section's lines of 4 characters or more, without marks in front and without headings; none for null."""
    rows = F.transform(lines_of(F.coalesce(section, F.lit(""))), lambda x: stripped(F.regexp_replace(x, "^[•\\-* \\t]+", "")))
    return F.filter(rows, lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*CERTIFICATE_HEADINGS))


def summary(section: Column, text: Column) -> Column:
    """The section in one line, if it has 20 characters; else the first of lines 2 to 8 of the text with 6 words and 35
    to 600 characters that holds no contact and starts with no bullet; null for none."""
    flat = stripped(F.regexp_replace(section, r"\s+", " "))
    rows = F.filter(F.transform(lines_of(text), stripped), lambda x: x != "")
    contact = f"{T.EMAIL}|{T.PHONE}|{T.LINK}|(?i:linkedin[.]com/|github[.]com/)"
    good = lambda x: ~x.rlike(contact) & ~x.rlike("^[-•*\uf0b7]") & (F.size(F.split(x, r"\s+")) >= 6) & F.length(x).between(35, 600)
    cleaned = F.transform(F.filter(F.slice(rows, 2, 7), good), T.clean_field)
    fallback = F.get(F.filter(cleaned, lambda x: x.isNotNull() & ~F.startswith(F.lower(x), F.lit("curriculum"))), F.lit(0))
    return F.when(F.length(flat) >= 20, flat).otherwise(fallback)


def routed_links(links: Column) -> Column:
    """portfolio (the first link that looks like one) and others, of the links to neither of the two profile sites."""
    open_ = F.filter(links, lambda x: ~F.lower(x).rlike("linkedin[.]com|linkiedin[.]com|github[.]com"))
    looks = "|".join(m.replace(".", "[.]") for m in PORTFOLIO_MARKS)
    first = F.get(F.filter(F.transform(open_, lambda x, i: F.struct(i.alias("at"), x.alias("link"))), lambda p: F.lower(p["link"]).rlike(looks)), F.lit(0))
    return T.let(first, lambda f: F.struct(f["link"].alias("portfolio"), F.filter(open_, lambda x, i: f["at"].isNull() | (i != f["at"])).alias("others")))


def skills_summary(skills: Column, tools: Column) -> Column:
    """Skills and tools in one line, once each in any case; null for none."""
    none = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(skills, none), F.coalesce(tools, none)), stripped)
    return F.nullif(F.array_join(once(F.filter(both, lambda x: x != "")), ", "), F.lit(""))


def highest_degree(degrees: Column) -> Column:
    """Of structs of degree and institution: `degree - institution` of the first with a degree; null for none."""
    first = F.get(F.filter(degrees, lambda d: F.coalesce(F.trim(d["degree"]) != "", F.lit(False))), F.lit(0))
    place = F.nullif(first["institution"], F.lit(""))
    return F.coalesce(F.concat(first["degree"], F.lit(" - "), place), F.trim(first["degree"]))


def is_json_array(value: Column) -> Column:
    """Whether a JSON text is an array; false for null and for what is no JSON."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(value)), F.lit("ARRAY")), F.lit(False))


#: The fields of a profile that may be edited, and other names of them.
EDITABLE = ("name", "email", "contact_no", "status", "notice_period", "current_ctc", "expected_ctc", "source", "notes")
OTHER_NAMES = {"full_name": "name", "phone": "contact_no", "remarks": "notes"}


def editable(updates: Column) -> Column:
    """Of a map of updates, the allowed fields under their own names with trimmed values, as entries in order of name
    given; null values change nothing. Of two names of one field the last entry counts."""
    names = F.create_map(*[F.lit(x) for kv in ({n: n for n in EDITABLE} | OTHER_NAMES).items() for x in kv])
    entries = F.transform(F.map_entries(updates), lambda e: F.struct(F.element_at(names, F.lower(stripped(e["key"]))).alias("key"), stripped(e["value"]).alias("value")))
    kept = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return T.let(kept, lambda a: F.map_from_entries(F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda o: o["key"] == e["key"]))))
