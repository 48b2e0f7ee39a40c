"""Positions held, read from the lines of a text: ranges of dates are anchors, and each anchor takes the lines around it.

The lines of a document stay in its row: an anchor's header lines (two back at most) and its body (up to the header of the
next anchor) are cut from the array of lines, and a position is read from each of these blocks where it lies. So a text is
read once, nothing is shuffled, and what becomes rows are positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import text as T
from vellumine.functions.skills import Words, stripped

#: Headings that are no content, what ends the part, labels above lists, words of companies.
HEADINGS = (
    "experience", "work experience", "professional experience", "employment history", "earlier experience", "responsibilities:", "responsibilities & impact:", "key achievements:",
    "work history", "career timeline", "career progression",
)
ENDS = ("declaration", "references", "place:", "date:", "signature")
LABELS = ("responsibilities:", "key responsibilities:", "key achievements:", "achievements:")
SUFFIXES = (
    "ltd", "pvt", "inc", "corp", "llc", "technologies", "technology", "industries", "services", "consultancy", "consulting", "engineering", "engineered", "solutions", "motors", "group",
    "ventures", "venture", "enterprises",
)
SUFFIXES_AFTER_IN = ("ltd", "pvt", "inc", "corp", "llc", "technologies", "industries", "limited", "steel", "motors", "group", "bank", "solutions")
COMPANY_PARTS = ("pvt", "ltd", "inc", "corp", "technologies", "solutions", "industries", "engineering", "products", "services", "group", "holdings")
ABBREVIATIONS = ("ltd.", "inc.", "pvt.", "corp.", "co.", "engg.", "tech.", "sr.", "jr.", "dept.", "mgmt.", "asst.", "assoc.", "st.", "div.")

_TIMES = r"(?i)\b[0-9]+\s*(?:years?|yrs?|months?|m)\b(?:\s*[0-9]+\s*(?:months?|m))?"


def _parts(role: Column | None, company: Column | None, place: Column | None) -> Column:
    clean = lambda c: F.lit(None).cast("string") if c is None else T.let(c, T.clean_field)
    return F.struct(clean(role).alias("role"), clean(company).alias("company"), clean(place).alias("place"))


def _pair(role: Column, rest: Column) -> Column:
    """role, and what stands before and after the first comma of the rest as company and place."""
    return _parts(role, F.substring_index(rest, ",", 1), F.when(F.contains(rest, F.lit(",")), F.regexp_replace(rest, r"^[^,]*,", "")))


def split_position(text: Column, words: Words) -> Column:
    """Struct of role, company and place of a header line.

    The first cut that applies: a known place alone; brackets; ` at ` or `@`; ` in ` before a company; bars, else commas,
    by which part names a company, a role or a place; a dash; else the line is a role if it names one, or a company.
    """
    role_words = tuple(w for w in words.roles if w not in ("engineering", "engineered"))
    has_role = lambda x: L.names(x, role_words)
    is_company = lambda x: (L.names(x, words.companies) | L.holds(x, SUFFIXES)) & ~has_role(x)
    untimed = lambda x: L.edged(F.regexp_replace(x, _TIMES, ""), r"\s.,")
    bracket, at, inside = r"^([^(]+?)\s*\((.*?)\)$", r"(?i)^(.*?)\s+(?:at|@)\s+(.*)$", r"(?i)^(.*?)\s+in\s+(.*)$"

    def around_company(others: Column, company: Column) -> Column:
        rest = F.filter(others, lambda x: ~has_role(x))
        later = F.get(F.filter(F.slice(rest, 2, F.size(others)), lambda x: ~L.is_place(x, words)), F.lit(0))
        return _parts(F.coalesce(F.get(F.filter(others, has_role), F.lit(0)), later), company, F.get(rest, F.lit(0)))

    def without_company(first: Column, second: Column, place: Column) -> Column:
        return (
            F.when(second.isNull(), F.when(has_role(first), _parts(first, None, place)).otherwise(_parts(None, first, place)))
            .when(has_role(first) & ~has_role(second), _parts(first, second, place))
            .when(has_role(second) & ~has_role(first), _parts(second, first, place))
            .otherwise(_parts(None, first, F.coalesce(place, second)))
        )

    def apart(parts: Column, body) -> Column:
        """body(first, second, place) of the parts: the first place among them, and the first two others."""
        place_at = F.array_position(F.transform(parts, lambda x: L.is_place(x, words)), True).cast("int")
        named = lambda k: F.filter(parts, lambda x, i: i != k - 1)
        facts = lambda k: T.let(named(k), lambda n: F.struct(F.get(n, F.lit(0)).alias("a"), F.get(n, F.lit(1)).alias("b"), F.get(parts, k - 1).alias("p")))
        return T.let(T.let(place_at, facts), lambda f: body(f["a"], f["b"], f["p"]))

    def by_parts(parts: Column) -> Column:
        others = lambda n: F.filter(F.transform(F.filter(parts, lambda x, i: i != n - 1), untimed), lambda x: x != "")
        with_company = lambda n: T.let(others(n), lambda o: around_company(o, L.edged(F.get(parts, n - 1))))
        plain = F.transform(parts, lambda x: F.coalesce(F.nullif(untimed(x), F.lit("")), x))
        without = T.let(plain, lambda p: apart(p, without_company))
        number = F.array_position(F.transform(parts, is_company), True).cast("int")
        return T.let(number, lambda n: F.when(n > 0, with_company(n)).when(F.size(parts) >= 2, without))

    def dashed(first: Column, second: Column, place: Column) -> Column:
        return F.when(second.isNull(), _parts(first, None, place)).when(L.holds(first, words.roles), _parts(first, second, place)).otherwise(_parts(second, first, place))

    def by_dash(parts: Column) -> Column:
        return apart(parts, dashed)

    def cut(line: Column) -> Column:
        trimmed = lambda parts: F.filter(F.transform(parts, stripped), lambda x: x != "")
        inner = L.edged(F.regexp_replace(F.regexp_extract(line, bracket, 2), r"(?i)(?:from\s+)?[0-9]{4}\s*(?:to|till|-|–)\s*(?:[0-9]{4}|present|current|till date).*$", ""))
        company = F.regexp_extract(line, inside, 2)
        after_in = L.holds(company, words.companies) | L.holds(company, SUFFIXES_AFTER_IN)
        parts = trimmed(F.when(F.contains(line, F.lit("|")), F.split(line, "[|]")).otherwise(F.split(line, ",")))
        return (
            F.when(F.coalesce(line == "", F.lit(True)), _parts(None, None, None))
            .when(L.is_place(line, words), _parts(None, None, line))
            .when(F.contains(line, F.lit("(")) & line.rlike(bracket) & (inner != ""), _pair(F.regexp_extract(line, bracket, 1), inner))
            .when(line.rlike(at), _pair(F.regexp_extract(line, at, 1), F.regexp_extract(line, at, 2)))
            .when(line.rlike(inside) & after_in, _pair(F.regexp_extract(line, inside, 1), company))
            .otherwise(
                F.coalesce(
                    F.when(line.rlike("[,|]"), T.let(parts, by_parts)),
                    F.when(line.rlike(" [-–] "), T.let(trimmed(F.when(F.contains(line, F.lit(" - ")), F.split(line, " - ")).otherwise(F.split(line, " – "))), by_dash)),
                    F.when(L.holds(line, words.roles), _parts(line, None, None)),
                    _parts(None, line, None),
                )
            )
        )

    return T.let(L.edged(text, r"\s,\-—–|"), cut)


def content_lines(text: Column) -> Column:
    """The lines of an experience part: without headings, up to the line that ends it, ranges cut by a line break joined."""
    kept = F.filter(L.text_lines(text), lambda x: ~F.lower(x).isin(*HEADINGS))
    # as many characters as the longest of ENDS decide
    ends = lambda x: F.lower(F.substring(x, 1, max(map(len, ENDS)))).rlike("^(?:" + "|".join(ENDS) + ")")
    cut = lambda a: T.let(F.array_position(F.transform(a, ends), True).cast("int"), lambda n: F.when(n > 0, F.slice(a, 1, n - 1)).otherwise(a))
    return T.let(T.let(kept, cut), rejoined)


def rejoined(a: Column) -> Column:
    """Lines of which one ends within a range of dates that the next goes on with, joined two by two."""
    cuts = F.transform(a, lambda x, i: F.coalesce(F.get(a, i + 1).rlike(L.RANGE_GOES_ON) & x.rlike(L.RANGE_CUT), F.lit(False)))

    def paired(s: Column) -> Column:
        n = F.size(s)
        opens = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~F.get(s, i - 1), i)), lambda i: i.isNotNull())
        firsts = T.let(opens, lambda o: F.flatten(F.transform(o, lambda x, k: F.sequence(x, F.coalesce(F.get(o, k + 1), n) - 1, F.lit(2)))))
        return F.transform(firsts, lambda i: F.when(F.get(s, i), F.concat_ws(" ", F.get(a, i), F.get(a, i + 1))).otherwise(F.get(a, i)))

    return T.let(cuts, lambda s: F.when(F.array_contains(s, True), paired(s)).otherwise(a))


def blocks(lines: Column, words: Words) -> Column:
    """A struct for each anchor: its line, the header lines before it (near, far), the next line, and its body."""
    keyed = lambda x: L.holds(x, words.roles) | L.holds(x, words.companies)
    anchors = F.filter(F.transform(lines, lambda x, i: F.when(L.dated(x) & (L.n_words(x) <= 16), i)), lambda i: i.isNotNull())

    def heads(x: Column) -> Column:
        short = F.lower(x).rlike("(?:" + "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS) + ")$")
        return F.coalesce(~L.is_bullet(x) & (L.n_words(x) <= 20) & ~(L.is_sentence(x) & ~short & ~keyed(x)), F.lit(False))

    def cut(a: Column) -> Column:
        def block(at: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(a, k - 1)).otherwise(F.lit(-1))
            header = lambda i: F.when(i > before, T.let(F.get(lines, i), lambda x: F.when(heads(x), x)))
            after = F.get(a, k + 1)
            return T.let(header(at - 1), lambda near: F.struct(
                F.get(lines, at).alias("line"), near.alias("near"), F.when(near.isNotNull(), header(at - 2)).alias("far"), after.isNotNull().alias("followed"),
                F.get(lines, at + 1).alias("next"), F.slice(lines, at + 2, F.coalesce(after, F.size(lines)) - at - 1).alias("body"),
            ))

        return F.transform(a, block)

    return T.let(anchors, cut)


def _body(body: Column, start: Column, followed: Column, words: Words) -> Column:
    """The body without the first `start` lines and, where another anchor follows, without that one's header: from behind,
    up to a bullet or sentence that names no role or company; without one, from the first line that names any."""

    def marked(x: Column, i: Column) -> Column:
        key = L.holds(x, words.roles) | L.holds(x, words.companies)
        return T.let(key, lambda named: F.struct(i.alias("i"), named.alias("key"), (~named & (L.is_bullet(x) | L.is_sentence(x))).alias("stop")))

    def cut(marks: Column) -> Column:
        inside = F.filter(marks, lambda m: m["i"] >= start)
        stop = F.array_max(F.transform(F.filter(inside, lambda m: m["stop"]), lambda m: m["i"])) + 1
        key = F.array_min(F.transform(F.filter(inside, lambda m: m["key"]), lambda m: m["i"]))
        return F.coalesce(stop, key, F.size(body))

    end = F.when(followed, T.let(F.transform(body, marked), cut)).otherwise(F.size(body))
    return F.slice(body, start + 1, F.greatest(end - start, F.lit(0)))


def highlights(body: Column) -> Column:
    bare = F.transform(body, L.unbulleted)
    good = F.filter(bare, lambda x: (x != "") & ~F.lower(x).isin(*LABELS) & ~((F.length(x) <= 4) & x.rlike("^[0-9]{1,2}$")))
    return F.filter(F.transform(good, T.clean_field), lambda x: x.isNotNull())


def _resolved(b: Column, words: Words) -> Column:
    """Struct of role, company and place of a block (with prefix, place0 and the header lines as split: s0, s1, s2) by what the
    prefix of the date, the header lines and the next line say."""
    said = lambda c: F.when(~c.rlike(L.DURATION), c)
    role_in = lambda c: L.holds(c, words.roles)
    near, far, next_ = b["near"], b["far"], b["next"]
    (r0, c0, p0), (r1, c1, p1), (r2, c2, p2) = ([b[s][k] for k in ("role", "company", "place")] for s in ("s0", "s1", "s2"))
    differs = lambda c, x: F.when(F.lower(c) != F.lower(x), c)
    neither, both1, two = r0.isNull() & c0.isNull(), r1.isNotNull() & c1.isNotNull(), far.isNotNull()
    lone = r1.isNull() & c1.isNull()

    def named(held: Column) -> Column:
        far_role, near_role = held["far"] & ~held["near"], held["near"] & ~held["far"]
        role = (
            F.when(r0.isNotNull(), r0)
            .when(near.isNull(), F.lit(None))
            .when(c0.isNotNull() | both1, r1)
            .when(two & far_role, F.coalesce(r2, far))
            .when(two, F.coalesce(r1, near))
            .when(lone & (held["near"] | ~L.holds(near, words.companies)), near)
            .otherwise(r1)
        )
        company = (
            F.when(c0.isNotNull(), c0)
            .when(near.isNull(), F.lit(None))
            .when(r0.isNotNull(), F.coalesce(said(c1), said(r1), said(near)))
            .when(both1, c1)
            .when(two & far_role, F.coalesce(differs(c1, far), near))
            .when(two & near_role, F.coalesce(differs(c2, near), far))
            .when(two, F.coalesce(c2, far))
            .when(lone & ~held["near"] & L.holds(near, words.companies), near)
            .otherwise(c1)
        )
        asked = near.isNotNull() & (r0.isNull() | c0.isNull())
        pair_places = F.when(near_role, F.coalesce(p1, p2)).otherwise(F.coalesce(p2, p1))
        header_place = F.when(asked, F.when(neither & ~both1 & two, pair_places).otherwise(p1))
        return F.struct(role.alias("role"), company.alias("company"), F.coalesce(b["place0"], p0, header_place).alias("place"), held.alias("held"))

    def other(s: Column) -> Column:
        fits = lambda x, held: F.when(held & F.coalesce(x != s["company"], F.lit(True)), x)
        return F.struct(F.coalesce(s["role"], fits(far, s["held"]["far"]), fits(near, s["held"]["near"])).alias("role"), s["company"].alias("company"), s["place"].alias("place"))

    def after(s: Column) -> Column:
        usable = ~L.is_bullet(next_) & (L.n_words(next_) <= 7)
        role_next = s["role"].isNull() & usable & role_in(next_)
        company_next = s["company"].isNull() & usable & ~role_next & L.holds(next_, words.companies)
        return F.struct(F.when(role_next, next_).otherwise(s["role"]).alias("role"), F.when(company_next, next_).otherwise(s["company"]).alias("company"), s["place"].alias("place"))

    held = F.struct(role_in(near).alias("near"), role_in(far).alias("far"))
    return T.let(T.let(T.let(held, named), other), after)


def _settled(role: Column, company: Column, highlights: Column, words: Words) -> Column:
    """Struct of role, company and highlights: role and company swapped where their words say so, and a role from the first
    highlights if none is left."""
    has_company = lambda c: L.names(c, words.companies) | L.holds(c, COMPANY_PARTS)
    client = lambda c: F.when(~c.rlike(L.DURATION), F.nullif(c, F.lit("")))

    def swapped(c: Column) -> Column:
        misplaced = has_company(role) & ~L.names(role, words.roles)
        held = F.struct(misplaced.alias("misplaced"), L.names(c, words.roles).alias("is_role"))

        def named(h: Column) -> Column:
            both = h["misplaced"] & (c.isNull() | h["is_role"])
            moved = role.isNull() & ~h["misplaced"] & h["is_role"] & ~has_company(c)
            return T.let(F.struct(both.alias("both"), moved.alias("moved")), lambda m: F.struct(
                F.when(m["both"] | m["moved"], c).otherwise(role).alias("role"), F.when(m["both"], role).when(~m["moved"], c).alias("company"),
            ))

        return T.let(held, named)

    def led(s: Column) -> Column:
        leads = F.transform(F.slice(highlights, 1, 2), lambda h: L.names(h, words.roles) & (L.n_words(h) <= 7))
        number = F.coalesce(F.when(s["role"].isNull(), F.array_position(leads, True).cast("int")), F.lit(0))
        return T.let(number, lambda n: F.struct(
            F.coalesce(s["role"], F.get(highlights, n - 1)).alias("role"), s["company"].alias("company"),
            F.when(n > 0, F.filter(highlights, lambda h, i: i != n - 1)).otherwise(highlights).alias("highlights"),
        ))

    return T.let(T.let(T.let(L.edged(F.regexp_replace(company, r"(?i)^client:\s*", "")), client), swapped), led)


POSITION = "struct<number:int,role:string,company:string,location:string,duration:string,start_date:string,end_date:string,is_current:boolean,highlights:array<string>>"


def _dated(b: Column, number: Column, words: Words) -> Column:
    """The position of a block, as POSITION."""

    def around(span: Column) -> Column:
        at = F.instr(b["line"], span)
        before, after = F.substring(b["line"], F.lit(1), at - 1), F.substring(b["line"], at + F.length(span), F.length(b["line"]))
        return F.struct(span.alias("span"), L.edged(before).alias("prefix"), L.edged(after).alias("suffix"))

    def headed(p: Column) -> Column:
        def parted(at_place: Column) -> Column:
            split = F.transform(F.array(F.when(at_place, F.lit("")).otherwise(p["prefix"]), b["near"], b["far"]), lambda x: split_position(x, words))
            place0 = T.clean_field(F.when(at_place, p["prefix"]).otherwise(p["suffix"]))
            return T.let(split, lambda s: F.struct(
                place0.alias("place0"), p["span"].alias("span"), *[F.get(s, F.lit(k)).alias(f"s{k}") for k in range(3)], *[b[c].alias(c) for c in ("near", "far", "next", "body", "followed")],
            ))

        return T.let(L.is_place(p["prefix"], words), parted)

    def read(h: Column) -> Column:
        def listed(s: Column) -> Column:
            start = F.when(F.coalesce(h["next"].isin(s["role"], s["company"]), F.lit(False)), 1).otherwise(0)
            kept = T.let(start, lambda n: highlights(_body(h["body"], n, h["followed"], words)))
            return F.struct(T.let(kept, lambda x: _settled(s["role"], s["company"], x, words)).alias("s"), T.parsed_range(h["span"]).alias("d"), s["place"].alias("place"))

        return T.let(T.let(_resolved(h, words), listed), shown)

    def shown(x: Column) -> Column:
        s, d = x["s"], x["d"]
        named = [T.clean_field(c) for c in (s["role"], s["company"], x["place"])]
        return F.struct((number + 1).alias("number"), *named, d["shown"], d["start"], d["end"], d["is_current"], s["highlights"])

    return T.let(T.let(T.let(F.regexp_extract(b["line"], L.RANGE, 0), around), headed), read)


def _undated(paragraph: Column, number: Column, words: Words) -> Column:
    """The position of a paragraph without dates, as POSITION."""
    none = F.lit(None).cast("string")

    def read(p: Column) -> Column:
        listed = F.filter(F.slice(p, 2, F.size(p)), lambda x: L.is_bullet(x) | (L.n_words(x) > 10))
        kept = F.filter(F.transform(listed, lambda x: T.clean_field(L.unbulleted(x))), lambda x: x.isNotNull())
        return T.let(F.struct(F.get(p, F.lit(0)).alias("first"), F.get(p, F.lit(1)).alias("second"), split_position(F.get(p, F.lit(0)), words).alias("s"), kept.alias("highlights")), shown)

    def shown(x: Column) -> Column:
        second = F.when(F.size(x["highlights"]) == 0, T.clean_field(x["second"]))
        role, company = F.coalesce(x["s"]["role"], T.clean_field(x["first"])), F.coalesce(x["s"]["company"], second)
        return F.struct((number + 1).alias("number"), role, company, x["s"]["place"], none, none, none, F.lit(False), x["highlights"])

    return T.let(L.text_lines(paragraph), read)


def held_positions(text: Column, words: Words) -> Column:
    """The positions that a text tells, in order, as an array of POSITION: what `positions` gives as rows."""
    kind = f"array<{POSITION}>"
    none = F.array().cast(kind)

    def of_lines(lines: Column) -> Column:
        undated = F.transform(T.paragraphs(text), lambda x, i: _undated(x, i, words)).cast(kind)
        dated = lambda b: F.transform(b, lambda x, i: _dated(x, i, words)).cast(kind)
        return F.when(F.size(lines) == 0, none).otherwise(T.let(blocks(lines, words), lambda b: F.when(F.size(b) == 0, undated).otherwise(dated(b))))

    found = T.let(content_lines(text), of_lines)
    return F.filter(F.coalesce(found, none), lambda p: ~F.coalesce(p["role"].rlike(L.DEGREE), F.lit(False)))


def positions(docs: DataFrame, id_: str, text: str, words: Words) -> DataFrame:
    """One row for each position of a document: id_, number (from 1), role, company, location, duration, start_date,
    end_date, is_current, highlights.

    Documents without a date range give a position for each paragraph. Positions whose role is a degree are left out.
    Null and empty texts have none. words' roles, companies and places are in lower case.
    """
    rows = docs.select(F.col(id_), held_positions(F.col(text), words).alias("_all"))
    return T.each(rows, "_all", id_).select(id_, "item.*")
