"""Candidates' facts, page matches, notes and profile parts over fixtures and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import insights, notes
from vellumine.functions.skills import Words
from vellumine.operators import extraction, pages
from vellumine.sources.tables import table

#: What is said before each turn of a conversation, by the number of its document and turn; {} is a number.
SAID = (
    "Availability: {} days. Present salary: {} lacs. ", "Notice period: ready to join, residing in pune, expected ctc {}% hike. ", "Serving notice - immediately; Current CTC: {}, expected salary: {}.5 lpa. ",
    "over {} years of experience. Location: phone home. ", "Total experience: {} yrs 3 months; based in New delhi. ", "",
)


def insights_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("conv_id") + F.col("turn"), (F.col("conv_id") % 60 + 1).cast("string")
    said = F.regexp_replace(F.get(F.array(*[F.lit(x) for x in SAID]), (k % len(SAID)).cast("int")), F.lit("[{][}]"), n)
    file = F.when(k % 7 == 0, F.concat(F.lit("Lorem["), n, F.lit("y_"), (k % 2).cast("string"), F.lit("m]-x.pdf"))).otherwise(F.lit("Lorem.pdf"))
    found = insights.insights(F.concat(said, "text"), file)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(name) for name, c in found.items()])


TITLES = {
    "Senior_Data-Engineer": "Senior Data Engineer", "java developer": "Java Developer", "sheetMetal_designer": "Sheet Metal Designer", "CIVIL.engineer(x)": "Civil Engineer", "embedded": "Embedded",
    "business-analyst": "Business Analyst", "qaEngineer": "Qa Engineer", "nothing": None,
}


def filename_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.get(F.array(*[F.lit(t) for t in TITLES]), (F.col("p_partkey") % len(TITLES)).cast("int"))
    file = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("-"), title, F.lit("[2024]_"), "p_brand", F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", insights.role_from_file(file).alias("role"))


def embedding_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for embeddings, as digests: source and language of a document, and its whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(insights.composite(source=F.col("source"), lang=F.col("lang"), text=F.col("text"))).alias("digest"))


def page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each conversation turn that holds the end of its last line, lines standing for pages."""
    lines = F.split("text", "\n")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(lines).alias("page", "text"))
    terms = docs.select("doc_id", F.substring(F.element_at(lines, -1), -12, 12).alias("term"))
    return pages.match_pages(terms, rows, "doc_id").select("doc_id", "page")


def profile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw profiles of parts, with markup, read as wholes: contacts, sections, positions, degrees and skills of each.

    A part is a few bytes, so that files of many parts are few tasks; parts are dealt out before their profiles are
    written. Every task unpacks the whole plan first (about half a second), so there are no more of them than cores can use.
    """
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey").select("p_partkey", F.split("p_name", " ").alias("w")).select("p_partkey", a.alias("a"), b.alias("b"))
    a, b, k = F.col("a"), F.col("b"), F.col("p_partkey").cast("string")
    raw = F.concat(
        F.lit("<html><script>x()</script><p>Curriculum Vitae</p><p>"), F.initcap(a), F.lit(" "), F.initcap(b), F.lit("</p><p>"), a, k, F.lit("@Example.org &amp; +91 98765 4"), F.lpad(k, 4, "0"), F.lit("</p><p>linkedin.com/in/"), b, k,
        F.lit("</p>\n<h2>SUMMARY</h2><p>Builds "), a, F.lit(" things for people who like\n"), b, F.lit(" things.</p><h2>Experience</h2><p>Senior Engineer at "), F.initcap(a), F.lit(" Labs, Pune</p><p>Jan 2020 - Present</p><li>• made "), b,
        F.lit(" well</li><p>"), F.initcap(b), F.lit(" Analyst (Foo Ltd)</p><p>2015 – 2019</p><h2>Education</h2><p>B.Tech Physics, "), F.initcap(a), F.lit(" College, 2014</p><h2>Skills</h2><p>Welding, "), b, F.lit("; react.js | ReactJS</p>"),
    )
    docs = parts.select("p_partkey", raw.alias("text"), F.concat(k, F.lit(".pdf")).alias("file"))
    words = Words(roles=("engineer", "analyst"), companies=("labs", "ltd"), places=("pune",))
    out = extraction.profiles(docs, "p_partkey", "text", "file", words, {"reactjs": "React"})
    job = lambda i: F.get("experience", F.lit(i))
    degree = F.get("education", F.lit(0))
    return out.select(
        "p_partkey", "name", "role", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "linkedin", "summary", F.array_join("skills", "|").alias("skills"),
        F.size("experience").cast("long").alias("n_positions"), *[job(0)[c].alias(f"first_{c}") for c in ("role", "company", "location", "duration")], F.array_join(job(0)["highlights"], "|").alias("first_highlights"),
        job(1)["role"].alias("second_role"), job(1)["company"].alias("second_company"), job(1)["duration"].alias("second_duration"), degree["degree"].alias("degree"), degree["institution"].alias("institution"), degree["end_date"].alias("end_date"),
    )


def notes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes: a JSON list of their turns, or the plain text of the only one; the last turn is noted once more,
    in front. Place, digest of the text and date of each note."""
    turn = F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("author"), "text", F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0")).alias("date"))
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("n")))).alias("turns"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: t["n"]).alias("turns")).withColumn("last", F.element_at("turns", -1)["text"])
    raw = F.when(F.size("turns") == 1, F.col("last")).otherwise(F.to_json("turns"))
    day = F.lit("2024-02-01")
    new = F.struct(F.lit("new").alias("id"), F.lit("c").alias("author"), F.trim("last").alias("text"), day.alias("date"))
    found = convs.select("conv_id", notes.prepend_note(notes.parse_notes(raw, day), new).alias("x"))
    return found.select("conv_id", F.posexplode("x").alias("place", "n")).select("conv_id", "place", F.md5("n.text").alias("digest"), "n.date")


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a number inside JSON properties, by kind of event; kinds and properties come as JSON-encoded values."""
    kind, props = notes.decoded(F.to_json(F.array("event_type")).substr(F.lit(2), F.length("event_type") + 2)), notes.decoded(F.col("props"))
    number = F.get_json_object(props, "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(kind.alias("event_type")).agg(F.count(number).alias("n"), F.sum(number).alias("total"))


QUERIES = {f.__name__: f for f in (notes_parse, json_values, insights_cascade, filename_role, embedding_composite, page_match, profile_parts)}


ORACLES = {
    "profile_parts": """
        with p as (select p_partkey as k, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] as ca, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] as cb from part)
        select k as p_partkey, ca || ' ' || cb as name, 'Senior Engineer' as role, a || k || '@example.org' as emails, '+91 98765 4' || lpad(k::varchar, 4, '0') as phones, 'https://www.linkedin.com/in/' || b || k as linkedin,
               'Builds ' || a || ' things for people who like ' || b || ' things.' as summary, 'Welding|' || cb || '|React' as skills, 2::bigint as n_positions, 'Senior Engineer' as first_role, ca || ' Labs' as first_company, 'Pune' as first_location,
               '2020-01 - Present' as first_duration, 'made ' || b || ' well' as first_highlights, cb || ' Analyst' as second_role, 'Foo Ltd' as second_company, '2015 - 2019' as second_duration, 'B.Tech Physics' as degree, ca || ' College' as institution, '2014' as end_date from p""",
    "notes_parse": """
        with c as (select *, count(*) over (partition by conv_id) as n, last_value(text) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as last from conversations),
        o as (select conv_id, turn, trim(last) as last, case when n = 1 then trim(text) else text end as text, case when n = 1 then '2024-02-01' else '2024-01-' || lpad((turn % 28 + 1)::varchar, 2, '0') end as date from c)
        select distinct conv_id, 0 as place, md5(last) as digest, '2024-02-01' as date from o
        union all
        select conv_id, (row_number() over (partition by conv_id order by turn))::int, md5(text), date from o where text <> last""",
    "json_values": "select event_type, count(props->>'$.k') as n, sum((props->>'$.k')::bigint)::bigint as total from events group by event_type",
    "insights_cascade": """
        with c as (select conv_id, turn, (conv_id + turn) % 6 as k, conv_id % 60 + 1 as n, (conv_id + turn) as s from conversations)
        select conv_id, turn, case k when 0 then n || ' days' when 1 then 'ready to join' when 2 then 'immediately' else 'Negotiable' end as notice_period,
               case k when 0 then n || ' lacs' when 2 then n || ' LPA' else 'Negotiable' end as current_pay, case k when 1 then n || '% hike' when 2 then n || '.5 lpa' else 'Negotiable' end as expected_pay,
               case k when 1 then 'Pune' when 4 then 'New Delhi' else 'Not Specified' end as location,
               case when s % 7 = 0 then case when s % 2 = 0 then n || ' Years' else n || 'y 1m' end when k = 3 then n || ' Years' when k = 4 then n || ' yrs 3 months' else 'Fresher' end as years
        from c""",
    "filename_role": "select p_partkey, ["
    + ", ".join("null" if v is None else f"'{v}'" for v in TITLES.values())
    + f"][p_partkey % {len(TITLES)} + 1] as role from part",
    "embedding_composite": """select doc_id, md5(concat_ws(' ', case when trim(source) <> '' then 'Source: ' || trim(source) end, case when trim(lang) <> '' then 'Lang: ' || trim(lang) end,
        case when trim(text) <> '' then 'Text: ' || trim(text) end)) as digest from documents""",
    "page_match": r"""
        with d as (select doc_id, string_split(text, chr(10)) as l from documents),
        t as (select doc_id, lower(right(l[-1], 12)) as term from d),
        p as (select doc_id, (generate_subscripts(l, 1) - 1)::int as page, lower(unnest(l)) as text from d),
        w as (select *, list_distinct(list_filter(regexp_split_to_array(term, '\s+'), lambda x: x <> '')) as w from t),
        s as (select doc_id, page, case when contains(text, term) then 1000000 else (select case when n >= greatest(1, len(w) // 2) then n end from (select len(list_intersect(w, regexp_split_to_array(text, '\s+'))) as n)) end as score from w join p using (doc_id)),
        b as (select doc_id, page, row_number() over (partition by doc_id order by score desc, page) as k from s where score is not null)
        select t.doc_id, b.page from t left join b on b.doc_id = t.doc_id and k = 1""",
}
