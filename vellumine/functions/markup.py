"""Visible text of markup, stitching of broken lines, and sections of a text, as column expressions over arrays of lines."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import text as T
from vellumine.functions.skills import lines_of, stripped

#: Elements that begin or end a line, and those whose content is not shown.
BLOCKS = ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "section", "article", "footer", "nav", "ul")
HIDDEN = ("script", "style")

#: Named entities and what they stand for, by the standard's list.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def unescaped(text: Column) -> Column:
    """Entities as the characters that they stand for: named ones, decimal and hexadecimal numbers; others as they stand."""
    names = F.map_from_arrays(F.split(F.lit(" ".join(ENTITIES)), " "), F.split(F.lit("\x01".join(ENTITIES.values())), "\x01"))

    def character(number: Column) -> Column:
        return F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))

    def resolved(piece: Column) -> Column:
        body = F.substring(piece, F.lit(2), F.length(piece) - 2)
        decimal, hexadecimal = F.regexp_extract(piece, "^&#([0-9]{1,7});$", 1), F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        number = F.coalesce(F.nullif(decimal, F.lit("")), F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10)).cast("long")
        return F.when(~piece.rlike("^&.+;$"), piece).otherwise(F.coalesce(F.try_element_at(names, body), character(number), piece))

    pieces = lambda t: F.regexp_extract_all(t, F.lit("&[#A-Za-z0-9]+;|[^&]+|&"), F.lit(0))
    return T.let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(pieces(t), resolved), "")).otherwise(t))


def visible_text(markup: Column) -> Column:
    """Text without tags, comments, scripts and styles, entities resolved, blanks collapsed, a line for each block; null for null."""
    bare = markup
    for name in HIDDEN:
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|$)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?(?:-->|$)", ""), r"(?s)<[!?][^>]*>", "")
    bare = F.regexp_replace(bare, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*|/)?>", "\n")
    bare = unescaped(F.regexp_replace(bare, "</?[A-Za-z][^>]*>", ""))
    rows = F.transform(F.split(bare, "\n"), lambda x: T.let(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "), stripped))
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


#: Words after which a sentence goes on, and headers of sections.
HANGING = ("and", "or", "with", "in", "for", "to", "of", "by", "on", "at", "from", "as", "including", "such", "the", "a", "an", "their", "our")
SECTION_WORDS = (
    "experience", "work experience", "education", "skills", "technical skills", "projects", "certifications", "achievements", "summary", "executive summary", "profile", "contact", "objective",
)

_DATED = rf"{L.RANGE}|(?i)\b(?:19|20)[0-9]{{2}}\b"


def stitched(lines: Column, roles: tuple[str, ...] = (), companies: tuple[str, ...] = (), headers: tuple[str, ...] = SECTION_WORDS) -> Column:
    """Lines with continuations joined to the line before them.

    A line goes on with the one before it if that ends in a comma, a hyphen or a word that calls for more; or if that is a
    bullet and this line starts in lower case. It does not if it is a bullet, a header, a short line with a date or a line with a
    contact, if the line before is empty, a header, a short line with a date or ends a sentence, or if that names a role and
    this one a company.

    What each line is by itself is found first, in one pass. The fold over the lines then carries a few facts of the line that
    is being built, and one mark a line; texts are joined once, from the marks.
    """
    is_header = lambda x: F.btrim(F.lower(x), F.lit(" :")).isin(*headers)
    ends = lambda x, *marks: reduce(or_, [F.endswith(x, F.lit(m)) for m in marks])

    def facts(x: Column) -> Column:
        digit = x.rlike("[0-9]")
        known = F.struct(is_header(x).alias("header"), (digit & x.rlike(_DATED)).alias("dated"), L.n_words(x).alias("n"), (F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("* "))).alias("bullet"))

        def told(k: Column) -> Column:
            shout = (k["n"] <= 4) & (x == F.upper(x)) & (x != F.lower(x))
            # what no contact of a kind lacks is looked for first
            contact = F.contains(x, F.lit("|")) | (F.contains(x, F.lit("@")) & x.rlike(T.EMAIL)) | (digit & x.rlike(T.PHONE)) | (F.contains(x, F.lit("/")) & (x.rlike(T.LINK) | x.rlike(T.LINKEDIN) | x.rlike(T.GITHUB)))
            # one character more than the longest of HANGING decides
            last = F.lower(F.regexp_extract(F.substring(x, F.lit(-1 - max(map(len, HANGING))), F.lit(1 + max(map(len, HANGING)))), r"(\S+)$", 1))
            return F.struct(
                (x == "").alias("empty"), *[k[c].alias(c) for c in ("bullet", "header", "n", "dated")], L.holds(x, roles).alias("role"), L.holds(x, companies).alias("company"),
                (k["bullet"] | k["header"] | (k["dated"] & (k["n"] <= 6)) | shout | contact).alias("apart"), ends(x, *".:;!?").alias("closed"),
                (ends(x, ",", "-") | last.isin(*HANGING)).alias("hangs"), F.substring(x, 1, 1).rlike(r"^\p{Ll}").alias("lower"),
            )

        return T.let(known, told)

    # of the line that is being built: marks so far, is it open at all, one line only, a header, a bullet, its words, a date, a role; of its last line: closed, hangs
    start = F.struct(F.lit("").alias("marks"), *[F.lit(False).alias(c) for c in ("open", "header", "bullet", "dated", "role", "closed", "hangs")], F.lit(0).alias("n"))

    def step(s: Column, f: Column) -> Column:
        short_date = s["dated"] & (s["n"] <= 6)
        goes_on = s["open"] & ~f["empty"] & ~f["apart"] & ~s["closed"] & ~s["header"] & ~short_date & ~(s["role"] & f["company"]) & (s["hangs"] | (f["lower"] & s["bullet"]))
        n = F.when(goes_on, s["n"] + f["n"]).otherwise(f["n"])
        return T.let(F.struct(goes_on.alias("g"), n.alias("n")), lambda d: F.struct(
            F.concat(s["marks"], F.when(d["g"], "1").otherwise("0")).alias("marks"), (~f["empty"]).alias("open"), (~d["g"] & f["header"]).alias("header"), F.when(d["g"], s["bullet"]).otherwise(f["bullet"]).alias("bullet"),
            (f["dated"] | (d["g"] & s["dated"])).alias("dated"), (f["role"] | (d["g"] & s["role"])).alias("role"), f["closed"].alias("closed"), f["hangs"].alias("hangs"), d["n"].alias("n"),
        ))

    def joined(a: Column) -> Column:
        marks = F.aggregate(F.transform(a, facts), start, step, lambda s: F.split(s["marks"], ""))
        firsts = T.let(marks, lambda m: F.filter(F.transform(a, lambda x, i: F.when(F.get(m, i) == "0", i)), lambda i: i.isNotNull()))
        return T.let(firsts, lambda o: F.transform(o, lambda i, k: F.array_join(F.slice(a, i + 1, F.coalesce(F.get(o, k + 1), F.size(a)) - i), " ")))

    return T.let(F.transform(lines, stripped), lambda a: F.when(F.size(a) > 0, joined(a)).otherwise(a))


def cleaned_document(text: Column, roles: tuple[str, ...] = (), companies: tuple[str, ...] = ()) -> Column:
    """Raw text as readable text: markup, if there is any, to visible text; entities; marks, dashes, bullets and page numbers;
    broken lines stitched; no more than one blank line in a row. Empty for null."""
    text = F.coalesce(text, F.lit(""))
    marked = text.rlike("(?s)<[A-Za-z/!][^>]*>")
    plain = T.clean_text(F.when(marked, visible_text(text)).otherwise(unescaped(text)))
    return stripped(F.regexp_replace(F.array_join(stitched(lines_of(plain), roles, companies), "\n"), r"\n{3,}", "\n\n"))


#: Section names by the headers that open them.
SECTIONS = {
    "summary": ("summary", "profile", "objective", "about me"),
    "experience": ("experience", "work experience", "employment", "work history"),
    "education": ("education", "academic background", "qualifications"),
    "skills": ("skills", "technical skills", "core competencies"),
    "projects": ("projects", "key projects"),
    "certifications": ("certifications", "certificates", "licenses"),
}


def sections(text: Column, headers: dict[str, tuple[str, ...]] = SECTIONS) -> Column:
    """A map of section names and their text; what stands before the first header is `header`.

    A header stands alone on its line, numbered or with a colon, or opens a line before a colon. Lines without text and rules
    are left out; a section that is opened twice holds both parts; sections without text are none.
    """
    names = F.create_map(*[F.lit(v) for name, hs in headers.items() for h in hs for v in (h, name)])
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s*(?:[0-9]+[.)]\s*)?|\s+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[-=_*~\s]+$"))

    def marked(x: Column) -> Column:
        head = F.lower(stripped(F.substring_index(x, ":", 1)))
        rest = F.when(F.contains(x, F.lit(":")), stripped(F.regexp_replace(x, "^[^:]*:", ""))).otherwise(F.lit(""))
        name = F.try_element_at(names, head)
        return F.struct(name.alias("name"), F.when(name.isNull(), x).otherwise(rest).alias("text"))

    def cut(m: Column) -> Column:
        opens = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | x["name"].isNotNull(), i)), lambda i: i.isNotNull())
        parts = lambda o: F.transform(o, lambda i, k: F.struct(F.coalesce(F.get(m, i)["name"], F.lit("header")).alias("name"), F.slice(m, i + 1, F.coalesce(F.get(o, k + 1), F.size(m)) - i).alias("rows")))
        return T.let(T.let(opens, parts), grouped)

    def grouped(parts: Column) -> Column:
        wanted = F.array_distinct(F.transform(parts, lambda p: p["name"]))
        rows = lambda n: F.flatten(F.transform(F.filter(parts, lambda p: p["name"] == n), lambda p: p["rows"]))
        texts = F.transform(wanted, lambda n: F.struct(n.alias("key"), F.array_join(F.filter(F.transform(rows(n), lambda r: r["text"]), lambda t: t != ""), "\n").alias("value")))
        return F.map_from_entries(F.filter(texts, lambda e: e["value"] != ""))

    return T.let(F.transform(kept, marked), cut)
