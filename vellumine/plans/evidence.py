"""Roles, primary fields, tables, refinement, model output and files over the driver's tables.

Names of parts, words of lines and keys of pages are written into the forms that the operators read; the SQL states what they
say instead of reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import grids, model_text, refine, roles
from vellumine.functions.skills import Words
from vellumine.sources import files
from vellumine.sources.tables import table

WORDS = Words(roles=("engineer", "analyst", "manager"), companies=("ltd", "labs"), places=("pune", "india"), stop=("hobbies",))


def _pick(k: Column, *values) -> Column:
    """The k-th of the values, from 0, repeating."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k % len(values)).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column, Column]:
    """Parts with k (their number) and the two words a and b of their names."""
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.split("p_name", " ").alias("w"))
    df = df.select("k", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
    return df, F.col("k"), F.col("a"), F.col("b")


def role_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role from each of the six sources in turn; better sources hold candidates that must be rejected."""
    df, k, a, b = _parts(spark, sf_dir)
    text = _pick(
        k, F.concat(F.lit("Jane Roe\nEducation lead\n"), a, F.lit(" engineer (2019 - present)\nx@y.org")), F.concat(F.lit("Jane Roe\nfive engineers did it.\n"), b), "Pune\nB.Tech engineer\nother", "hobbies of an analyst", "plain",
        "we use SCADA here",
    )
    held = F.when(k % 6 <= 1, F.array(F.lit("B.Sc analyst"), F.lit("x"), F.concat(a, F.lit(" analyst (Foo Ltd)"))))
    summary = F.when(k % 6 <= 2, F.concat(F.lit("Jane Roe is a "), a, F.lit(" Designer with 3 years")))
    rows = F.when(k % 6 <= 3, F.array(F.array(F.lit("notice of a manager"), F.lit("x")), F.array(F.lit("Designation"), F.concat(b, F.lit(" keeper")))))
    file = F.when(k % 6 <= 4, F.concat(F.lit("x_Java-Developer_"), a, F.lit(".pdf"))).otherwise(F.lit("x.pdf"))
    return df.select(k.alias("p_partkey"), roles.role(text, WORDS, F.lit("Jane Roe"), held, summary, rows, file).alias("role"))


def primary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid name, address, number and role, where first candidates are rejected."""
    df, k, a, b = _parts(spark, sf_dir)
    names = F.array(_pick(k, "Document 7", " ", "www.x.com"), _pick(k, F.concat(a, F.lit(" "), b), F.lit("resume"), F.concat(b, F.lit(" github"))), F.when(k % 2 == 0, F.concat(F.lit(" "), b, F.lit(" "))))
    phones = F.array(F.lit(" "), F.when(k % 3 == 0, F.lit(" 98765 43210 ")))
    text = F.concat(F.lit("call 12345 67890 or "), F.lit("9876543211\nSkills of an engineer\nsenior "), a, F.lit(" analyst (2019)\n"), b, F.lit(" manager."))
    held = F.when(k % 4 == 0, F.array(F.lit("(x ltd)"), F.concat(a, F.lit(" lead"))))
    role = roles.primary_role(F.when(k % 5 == 0, F.lit("(2020)")), held, F.when(k % 4 == 1, text), F.when(k % 4 == 2, F.concat(F.lit("A "), a, F.lit(" Designer with 3 years"))), F.array(F.lit("how many managers"), F.concat(b, F.lit(" Architect"))), F.lit("x.pdf"), F.array(a, b))
    return df.select(
        k.alias("p_partkey"), roles.primary_name(names, F.concat(F.initcap(a), F.initcap(b), F.lit("_Resume.pdf"))).alias("name"),
        roles.primary_email(F.array(F.lit(""), F.concat(F.lit(" "), a, F.lit("@x.org")))).alias("email"), roles.primary_phone(phones, text).alias("phone"), role.alias("role"),
    )


def table_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each document: its lines as rows, cells from their first words, under one of four headers."""
    word = lambda x, i: F.coalesce(F.get(F.regexp_extract_all(x, F.lit(r"\p{L}+"), F.lit(0)), F.lit(i)), F.lit("nil"))
    k = F.col("doc_id")
    headers = (
        ("Project Name", "Tech Stack", "Description"), ("S.No", " Qualification", "University", "Year of passing", "CGPA"), ("Duration", "Employer", "Designation"), ("colour", "size", "taste"),
    )
    year = lambda i: (F.lit(1990) + i % 20).cast("string")

    def row(x: Column, i: Column) -> Column:
        a, b, c = (F.concat(word(x, j), F.lit("q")) for j in range(3))
        rows = (
            F.array(a, F.concat(b, F.lit(", sales manager; "), c, F.lit("|x")), F.concat(c, F.lit(" *"))), F.array(i.cast("string"), a, F.concat(F.lit(" "), b), year(i), F.lit("8.1")),
            F.array(F.concat(F.lit("Jan "), year(i), F.lit(" - Present")), b, c), F.array(a, b, c),
        )
        return _pick(k, *rows)

    header = _pick(k, *[F.array(*map(F.lit, h)) for h in headers])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array(header), F.transform(F.split("text", "\n"), row)).alias("t"))
    out = grids.table_entities(docs, "doc_id", "t", WORDS)
    return out.select("doc_id", F.col("number").cast("long").alias("number"), "kind", "title", "organisation", "duration", "start_date", "end_date", "is_current", "details", F.array_join("items", "|").alias("items"))


def refined_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of parts, each of which needs most of the rules."""
    df, k, a, b = _parts(spark, sf_dir)
    even = k % 2 == 0
    experience = F.struct(
        F.when(even, F.concat(b, F.lit(" pvt ltd"))).otherwise(F.concat(a, F.lit(" analyst ("), b, F.lit(" labs from 2001 to 2003)"))).alias("role"), F.when(even, F.concat(a, F.lit(" manager"))).alias("company"),
        F.lit(" Pune, ").alias("location"), F.array(F.concat(F.lit("• **did "), a, F.lit("**")), F.concat(F.lit("Key Achievements: "), b), F.lit("ok"), F.lit("done!")).alias("highlights"),
    )
    education = F.struct(F.lit("b.sc physics (").alias("degree"), F.concat(a, F.lit(" college")).alias("institution"), F.lit(" 8.1 ;").alias("details"))
    profiles = df.select(
        k.alias("p_partkey"), F.concat(F.initcap(a), F.initcap(b), F.lit("_Resume.pdf")).alias("file_name"),
        _pick(k, F.concat(F.lit("mr. "), a, F.lit(" "), b), F.concat(F.lit("Dr "), F.upper(a), F.lit(" "), F.upper(b), F.lit("! NPU call")), F.lit(None).cast("string")).alias("name"),
        _pick(k, F.concat(F.lit("senior "), a, F.lit(" engineer (2019 - present)")), F.concat(a, F.lit(" pvt ltd")), F.lit("lead ("), F.lit(None).cast("string")).alias("role"),
        F.when(even, F.lit("mail x@y.z")).otherwise(F.lit("A fine worker")).alias("summary"), F.array(a, F.concat(F.lit("aws certified "), b), F.lit("react.js"), F.lit("React JS")).alias("skills"),
        F.array(F.concat(F.lit("B.Tech from "), a), F.concat(F.lit("PMP "), b), F.lit("90% score"), F.lit("x")).alias("certifications"),
        F.array(F.lit("hindi "), F.lit("english"), F.lit("what is your ctc"), F.lit("c2"), F.lit("ENGLISH")).alias("languages"), F.array(experience).alias("experience"), F.array(education).alias("education"),
    )
    out = refine.refined(profiles, WORDS, {"reactjs": "React"})
    e, d = F.get("experience", F.lit(0)), F.get("education", F.lit(0))
    return out.select(
        "p_partkey", "name", "role", "summary", e["role"].alias("position"), e["company"].alias("company"), e["location"].alias("location"), F.array_join(e["highlights"], "|").alias("highlights"),
        d["degree"].alias("degree"), d["institution"].alias("institution"), d["details"].alias("details"), *[F.array_join(c, "|").alias(c) for c in ("skills", "certifications", "languages")],
    )


def model_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a model would write them: each line an element, blank ones too, with control tokens, and a broken element
    between every two."""

    def element(x: Column, i: Column) -> Column:
        n = i.cast("string")
        return F.concat(F.lit("<x_0."), n, F.lit("><y_"), n, F.lit("><tbc>"), x, F.lit("\n\\unknown<x_1><y_0.5><class_"), F.when(i % 2 == 0, "Text").otherwise("Title"), F.lit(">"), F.when(i % 3 == 0, F.lit("<x_broken> ")).otherwise(F.lit(" ")))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), element), "").alias("o"))
    got = model_text.aligned(F.col("o"))
    out = docs.select("doc_id", *[c.alias(n) for n, c in got.items()])
    corners = F.aggregate(F.transform("boxes", lambda b: F.get(b, F.lit(1))), F.lit(0.0), lambda x, y: x + y)
    return out.select("doc_id", F.size("texts").cast("long").alias("n"), F.md5(F.array_join("texts", "\n")).alias("digest"), F.size(F.filter("classes", lambda c: c == "Title")).cast("long").alias("titles"), corners.alias("corners"), F.size("faults").cast("long").alias("faults"))


def extracted_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as extractors leave them: control characters, mixed line ends, blanks and blank lines."""
    dirty = F.regexp_replace(F.regexp_replace("text", "[.] ", ".\x07 \t \r\n \r \n\n"), ", ", " ,\x0b\x7f  ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(model_text.clean_extracted(F.concat(F.lit(" \n\n"), dirty, F.lit(" \r")))).alias("digest"))


def files_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for pages' files: by recorded path, exact name, stem or JSON record, in that order, or not at all. Which of
    these files exist depends on a page's number."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("n"))
    k = F.col("page_id")
    wanted = pages.select("page_id", k.alias("document_id"), F.when(k % 2 == 0, F.concat("n", F.lit(".pdf"))).alias("file_name"))
    known = pages.filter(k % 7 != 6).select(k.alias("document_id"), F.concat("n", F.lit(".pdf")).alias("file_name"), F.concat(F.lit("/data/"), "n", F.lit(".doc")).alias("file_url"))
    some = lambda folder, name, ending: F.struct(F.concat(F.lit(f"/{folder}/"), name, F.lit(ending)).alias("path"), F.lit(folder).alias("folder"))
    offers = F.array(
        F.when(k % 5 == 0, some("data", F.col("n"), ".doc")), F.when(k % 3 == 0, some("upload", F.col("n"), ".pdf")), F.when(k % 4 == 0, some("files", F.col("n"), ".pdf")),
        F.when(k % 11 < 5, some("files", F.upper("n"), ".DOCX")), F.when(k % 13 < 9, some("records", F.col("n"), ".json")), some("elsewhere", F.col("n"), ".pdf"),
    )
    there = pages.select(F.explode(F.filter(offers, lambda o: o.isNotNull())).alias("o")).select("o.*")
    return files.resolved_files(wanted, known, there, "page_id", ("upload", "files"), "records")


QUERIES = {f.__name__: f for f in (role_evidence, primary_fields, table_entities, refined_profiles, model_elements, extracted_clean, files_resolved)}

_P = "p as (select p_partkey, p_partkey as k, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] as ca, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] as cb from part)"

ORACLES = {
    "role_evidence": f"""with {_P} select p_partkey, case k % 6 when 0 then ca || ' Engineer' when 1 then ca || ' Analyst' when 2 then ca || ' Designer' when 3 then cb || ' Keeper'
        when 4 then 'Java Developer' else 'Electrical Engineer' end as role from p""",
    "primary_fields": f"""with {_P} select p_partkey, case when k % 3 = 0 then a || ' ' || b when k % 2 = 0 then b else ca || ' ' || cb end as name, a || '@x.org' as email,
        case when k % 3 = 0 then '98765 43210' else '12345 67890' end as phone,
        case k % 4 when 0 then ca || ' Lead' when 1 then 'Senior ' || ca || ' Analyst' when 2 then ca || ' Designer' else cb || ' Architect' end as role from p""",
    "table_entities": r"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as number from documents),
        w as (select doc_id, number, doc_id % 4 as k, 1990 + (number - 1) % 20 as y, list_transform(range(1, 4), lambda i: coalesce(regexp_extract_all(x, '\p{L}+')[i], 'nil') || 'q') as w from l)
        select doc_id, number, case k when 0 then 'project' when 1 then 'education' else 'experience' end as kind, case k when 2 then w[3] else w[1] end as title, case k when 0 then null else w[2] end as organisation,
               case k when 1 then y::varchar when 2 then y || '-01 - Present' end as duration, case k when 2 then y || '-01' end as start_date, case k when 1 then y::varchar end as end_date, k = 2 as is_current,
               case k when 0 then w[3] when 1 then '8.1' end as details, case k when 0 then w[2] || '|' || w[3] else '' end as items
        from w where k < 3""",
    "refined_profiles": f"""
        with {_P},
        r as (select *, case k % 4 when 0 then 'Senior ' || ca || ' Engineer' when 2 then 'Lead' else ca || ' Analyst' end as role from p)
        select p_partkey, ca || ' ' || cb as name, role, case when k % 2 = 0 then 'Results-driven ' || role || ' at ' || a || ' manager with strong expertise in ' || a || ', aws certified ' || b || ', react.js, React JS.' else 'A fine worker' end as summary,
               case when k % 2 = 0 then a || ' manager' else ca || ' Analyst' end as position, case when k % 2 = 0 then cb || ' Pvt Ltd' else b || ' labs' end as company, 'Pune' as location,
               'did ' || a || '.' || case when length(b) >= 5 then '|' || b || '.' else '' end || '|done!' as highlights, 'B.Sc Physics' as degree, ca || ' College' as institution, '8.1' as details,
               ca || '|React' as skills, 'PMP ' || b || '|aws certified ' || b as certifications, 'English|Hindi' as languages from r""",
    "model_elements": r"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
        t as (select doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') as x from l)
        select doc_id, count(*) filter (x <> '') as n, md5(coalesce(string_agg(x, chr(10) order by i) filter (x <> ''), '')) as digest, count(*) filter (x <> '' and i % 2 = 1) as titles,
               coalesce(sum(i) filter (x <> ''), 0)::double as corners, count(*) filter (i % 3 = 0) as faults from t group by doc_id""",
    "extracted_clean": r"""
        with d as (select conv_id, turn, ' ' || chr(10) || chr(10) || replace(replace(text, '. ', '.' || chr(7) || ' ' || chr(9) || ' ' || chr(13) || chr(10) || ' ' || chr(13) || ' ' || chr(10) || chr(10)), ', ', ' ,' || chr(11) || chr(127) || '  ') || ' ' || chr(13) as t from conversations),
        l as (select conv_id, turn, list_transform(string_split(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\r\n|\r', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) as l from d)
        select conv_id, turn, md5(regexp_replace(array_to_string(list_filter(l, lambda x, i: x <> '' or i = 1 or l[i - 1] <> ''), chr(10)), '^\s+|\s+$', '', 'g')) as digest from l""",
    "files_resolved": """
        with p as (select page_id as k, 'p' || page_id as n, page_id % 7 <> 6 as known, page_id % 2 = 0 or page_id % 7 <> 6 as named from pages),
        l as (select *, case when known and k % 5 = 0 then 1 when named and (k % 3 = 0 or k % 4 = 0) then 2 when named and k % 11 < 5 then 3 when named and k % 13 < 9 then 4 end as level from p),
        f as (select *, case level when 1 then '/data/' || n || '.doc' when 2 then case when k % 3 = 0 then '/upload/' else '/files/' end || n || '.pdf' when 3 then '/files/' || upper(n) || '.DOCX' when 4 then '/records/' || n || '.json' end as path from l)
        select k as page_id, level, path, case level when 1 then n || '.pdf' when 2 then n || '.pdf' when 3 then upper(n) || '.DOCX' when 4 then n || '.json' end as shown,
               case level when 1 then 'application/msword' when 2 then 'application/pdf' when 3 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' when 4 then 'application/json' end as media_type
        from f""",
}
