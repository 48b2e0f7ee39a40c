"""Text cleaning, extraction, dates, names, scores and classes over the driver's tables and small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import scoring, text
from vellumine.sources.tables import table

SKILLS = ("reactjs", "React.js", "postgres", "k8s", "golang", "data analysis", "AWS", "javaScript tools", "  c++ ")
ALIASES = {"reactjs": "React", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "k8s": "Kubernetes", "golang": "Go", "c++": "C++"}
TAXONOMY = {"articles": {"the": 3.0, "of": 1.5, "and": 1.5}, "german": {"der": 3.0, "die": 1.5, "und": 1.5}, "french": {"le": 3.0, "de": 1.5, "et": 1.5}, "spanish": {"el": 3.0, "la": 1.5, "de": 1.5}}
TERMS = ("the", "der", "les", "of", "is", "and", "por", "zu")


def _joined(c, by: str = "|"):
    return F.array_join(c, by)


def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.emails(F.col("text")).alias("x"))
    return found.filter(F.size("x") > 0).select("doc_id", _joined("x").alias("emails"))


def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.phones(F.col("text")).alias("x"))
    return found.filter(F.size("x") > 0).select("doc_id", _joined("x").alias("phones"))


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", text.links(F.concat_ws(" ", "url", "html")).alias("x"))
    return found.select("page_id", F.size("x").cast("long").alias("n"), _joined("x").alias("links"))


def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles on two sites that stand behind each page; some of them are the site's own pages."""
    user = F.when(F.col("page_id") % 3 == 0, F.lit("Features")).otherwise(F.concat(F.lit("u_"), F.col("page_id").cast("string")))
    whole = F.concat(F.lit("see "), "url", F.lit(" "), "html", F.lit(" LinkedIn.com/in/"), F.col("page_id").cast("string"), F.lit("-x, http://www.github.com/"), user, F.lit("/repo"))
    found = text.profile_links(whole)
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in found.items()])


def word_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", text.paragraphs(F.col("text"), r"\n").alias("x"))
    return parts.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "\n")).alias("digest"))


def clean_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.clean_field(F.col("text"))).alias("digest"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("Page 1 of 2\n• "), F.col("text"), F.lit(" “x”–y\nmicro-\nscope\n\n\n\n- 2 -\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(marked)).alias("digest"))


def skill_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, kinds and known spellings of skills, by part."""
    k = F.col("p_partkey")
    known = F.get(F.array(*[F.lit(x) for x in SKILLS]), (k % len(SKILLS)).cast("int"))
    value = F.when(k % 2 == 0, known).when(k % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("  "), F.lower("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_skill(value, ALIASES).alias("skill"))


def date_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of orders, from their date to 400 days later, in eight spellings."""
    a, b = F.col("o_orderdate"), F.date_add("o_orderdate", 400)
    of = F.date_format
    spellings = (
        F.concat(of(a, "MMM yyyy"), F.lit(" - Present")), F.concat(of(a, "MM/yyyy"), F.lit(" to "), of(b, "MM/yyyy")), of(a, "yyyy"), F.concat(of(a, "yyyy"), F.lit("–"), of(b, "yyyy")),
        F.concat(of(a, "MMMyyyy"), F.lit("-"), of(b, "MMMyyyy")), F.concat(F.lit("Since "), of(a, "yyyy")), F.concat(F.lit("Until "), of(a, "MMMM yyyy")), F.concat(F.lit("'"), of(a, "yy"), F.lit(" - '"), of(b, "yy")),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*spellings), (F.col("o_orderkey") % 8).cast("int")).alias("t"))
    d = text.parsed_range(F.col("t"))
    return orders.select("o_orderkey", d["start"].alias("start_date"), d["end"].alias("end_date"), d["is_current"].alias("is_current"), d["shown"].alias("shown"))


FILE_MARKS = ("_Resume_2024.docx", "--npu.docx", "[5y_0m]-WA-npu- call later-26 aug.docx", "_ask if available- fwd.docx", " P M.DOCX")


def filename_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as names of people in camel case, with what recruiters write behind them; and names that no file may have."""
    k = F.col("p_partkey")
    file = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.get(F.array(*[F.lit(x) for x in FILE_MARKS]), (k % len(FILE_MARKS)).cast("int")))
    bad = F.when(k % 10 == 0, F.lit(" ")).otherwise(F.concat("p_brand", F.lit(":"), "p_type", F.lit("?*|")))
    return table(spark, sf_dir, "part").select("p_partkey", text.name_from_file(file).alias("name"), text.safe_file_name(bad).alias("safe"))


def sections_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines under their role as a header: the turns and the length of each section."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.length("text").alias("n"))
    return turns.groupBy("conv_id", "role").agg(F.count("*").alias("lines"), F.sum("n").cast("long").alias("chars"))


def dictionary_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _joined(text.dictionary_hits(F.col("text"), TERMS), ",").alias("terms"))


def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), "[ \n]+").alias("words"))
    return scoring.classify(words, "doc_id", "words", TAXONOMY)


def ats_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of profiles derived from the documents: counts of lines and characters stand for sections."""
    lines = F.size(F.split("text", "\n"))
    n = F.col("n_chars")
    profile = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(n % 3 == 0, "Lorem Ipsum").otherwise("Lorem").alias("name"), F.col("text").alias("summary"), F.when(n % 5 == 0, "failed").alias("error_message"),
        (n % 2).alias("n_emails"), (n % 4).alias("n_phones"), (n % 7).alias("n_profiles"), lines.alias("n_skills"), (n % 3).alias("n_experience"), (n % 2).alias("n_education"), (n % 6).alias("n_projects"),
        (n > 500).alias("has_role"), (n > 800).alias("has_company"), (n > 1000).alias("has_dates"), (n > 3000).alias("has_highlights"),
    )
    return scoring.profile_score(profile).select("doc_id", "contact", "completeness", "skills_score", "experience_score", "formatting", "overall", "grade", F.size("strengths").alias("n_strengths"))


def profile_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What profiles are praised for and what is suggested to them; numbers of the labels, lines and words stand for sections."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").join(labels, "doc_id", "left")
    lines, n = F.size(F.split("text", "\n")), F.length("text")
    profile = docs.select(
        "doc_id", F.substring_index("text", " ", 1).alias("name"), F.substring_index("text", "\n", 1).alias("summary"), F.when(F.col("t") == 1, "toxic").alias("error_message"), F.col("q").alias("n_emails"),
        (lines - 1).alias("n_phones"), F.when(F.col("lang") == "en", 1).alias("n_profiles"), lines.alias("n_skills"), F.col("t").alias("n_experience"), F.col("q").alias("n_education"), (n % 2).alias("n_projects"),
        (n > 900).alias("has_highlights"),
    )
    return profile.select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in scoring.advice(profile).items()])


QUERIES = {
    f.__name__: f
    for f in (
        extract_emails, extract_phones, extract_links, contact_links, word_char_counts, paragraph_split, clean_field, clean_text, skill_normalize, date_range_parse, filename_name, sections_map,
        dictionary_tools, domain_classify, ats_score, profile_advice,
    )
}


def _case(pairs, otherwise: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


ORACLES = {
    "profile_advice": """
        with l as (select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id),
        p as (select doc_id, length(string_split(text, ' ')[1]) > 0 as one, string_split(text, ' ')[1] as name, length(trim(string_split(text, chr(10))[1])) as s, coalesce(q, 0) as q, coalesce(t, 0) as t, len(string_split(text, chr(10))) as k,
                     coalesce(lang = 'en', false) as en, length(text) as n from documents left join l using (doc_id) where text is not null),
        f as (select *, len(list_filter(string_split_regex(trim(name), '\\s+'), lambda w: w <> '')) as words from p)
        select doc_id,
               array_to_string(list_filter([case when q > 0 then 'Professional email address detected.' end, case when en then 'Professional online profile links (LinkedIn/GitHub) present.' end,
                 case when s > 30 then 'Engaging professional summary present.' end, case when n % 2 > 0 then 'Showcases portfolio projects and/or professional certifications.' end,
                 case when k >= 12 then 'Rich technical keyword density with ' || k || ' recognized skills.' when k >= 8 then 'Solid skills coverage with ' || k || ' skills.' end,
                 case when t > 0 and n > 900 then 'Structured role bullet points with responsibilities and achievements.' end, case when t = 0 then 'Clean document structure with 100% ATS parseability.' end], lambda x: x is not null)[1:4], '|') as praise,
               array_to_string(list_filter([case when words < 2 then 'Clearly state your full name prominently at the top of your resume.' end, case when q = 0 then 'Add a professional email address for recruiter contact.' end,
                 case when k = 1 then 'Include a valid contact phone number with country code.' end, case when not en then 'Include a customized LinkedIn or GitHub profile link.' end,
                 case when s <= 30 then 'Add a 2-3 sentence professional summary highlighting your core expertise.' end, case when k < 3 then 'Include a dedicated Technical Skills section.' end,
                 case when t = 0 then 'Include work experience, internships, or professional projects.' end, case when q = 0 then 'List your educational degrees and graduating institutions.' end,
                 case when n % 2 = 0 then 'Add key projects or certifications to demonstrate practical expertise.' end, case when k <= 3 then 'Expand your skills section with relevant frameworks, tools, and libraries.' end,
                 case when t > 0 and n <= 900 then 'Use bullet points with action verbs and quantifiable results in experience.' end, case when t = 0 and q = 0 then 'Detail your work history with job titles, companies, and dates.' end,
                 case when t = 1 then 'Resolve formatting issue: toxic' end], lambda x: x is not null)[1:4], '|') as suggestions
        from f""",
    "extract_emails": r"""
        with e as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+'), lambda x: regexp_replace(lower(x), '[.,;)]+$', '')),
                          lambda x: not regexp_matches(x, '\.(png|jpg|jpeg|gif|webp|pdf|docx|doc)$')) as x from documents)
        select doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), '|') as emails from e where len(x) > 0""",
    "extract_phones": r"""
        with e as (select doc_id, list_transform(regexp_extract_all(text, '(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}|(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|0?[6-9]\d{9}'), lambda x: trim(x)) as x from documents),
        d as (select doc_id, list_filter(list_transform(x, lambda v: {'n': regexp_replace(v, '[^0-9]', '', 'g'), 'v': v}),
                     lambda y: length(y.n) between 10 and 15 and len(list_distinct(string_split(y.n, ''))) > 2 and not regexp_matches(y.n, '^(19|20)..20(1[89]|2[0-6])..$')) as y from e)
        select doc_id, array_to_string(list_slice(list_transform(list_filter(y, lambda p, i: list_position(list_transform(y, lambda q: q.n), p.n) = i), lambda p: p.v), 1, 4), '|') as phones from d where len(y) > 0""",
    "extract_links": r"""
        with e as (select page_id, list_transform(regexp_extract_all(concat_ws(' ', url, html), '(?i)https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_+.~#?&/=]*'), lambda x: regexp_replace(x, '[.,;)]+$', '')) as x from pages),
        u as (select page_id, list_filter(x, lambda v, i: list_position(x, v) = i) as x from e)
        select page_id, len(x) as n, array_to_string(x, '|') as links from u""",
    "contact_links": "select page_id, 'https://www.linkedin.com/in/' || page_id || '-x' as linkedin, case when page_id % 3 <> 0 then 'https://github.com/u_' || page_id end as github from pages",
    "word_char_counts": r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::bigint as words, length(text) as chars from documents",
    "paragraph_split": r"with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as x from documents) select doc_id, len(x) as n, md5(array_to_string(x, chr(10))) as digest from p",
    "clean_field": r"select conv_id, turn, md5(nullif(regexp_replace(regexp_replace(regexp_replace(text, '[*_`#]+', '', 'g'), '\s+', ' ', 'g'), '^[\s,;:|\-]+|[\s,;:|\-]+$', '', 'g'), '')) as digest from conversations",
    "clean_text": r"""
        with m as (select doc_id, 'Page 1 of 2' || chr(10) || '• ' || text || ' “x”–y' || chr(10) || 'micro-' || chr(10) || 'scope' || chr(10) || chr(10) || chr(10) || chr(10) || '- 2 -' || chr(10) || 'end' as t from documents),
        a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[“”]', '"', 'g'), ' *[–—] *', ' - ', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g') as t from m),
        b as (select doc_id, regexp_replace(regexp_replace(t, '(?m)^[ \t]*[•●➢▪*][ \t]*', '- ', 'g'), '(?mi)^[ \t]*(?:page[ \t]+[0-9]+(?:[ \t]+of[ \t]+[0-9]+)?|-[ \t]*[0-9]+[ \t]*-)[ \t]*$', '', 'g') as t from a)
        select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as digest from b""",
    "skill_normalize": f"""
        with v as (select p_partkey, case when p_partkey % 2 = 0 then [{", ".join(f"'{x}'" for x in SKILLS)}][p_partkey % {len(SKILLS)} + 1] when p_partkey % 3 = 0 then p_type else ' ' || p_name || '  ' || lower(p_type) end as value from part),
        s as (select p_partkey, regexp_replace(trim(value), '\\s+', ' ', 'g') as b from v),
        k as (select *, regexp_replace(lower(b), '[\\s._\\-]+', '', 'g') as key from s)
        select p_partkey, {_case([(f"key = '{a}'", f"'{c}'") for a, c in ALIASES.items()] + [("(length(b) <= 5 and b = upper(b)) or regexp_matches(b, '[a-z][A-Z]')", "b")], "list_reduce(list_transform(string_split(b, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda x, y: x || ' ' || y)")} as skill from k""",
    "date_range_parse": """
        with d as (select o_orderkey, o_orderkey % 8 as k, o_orderdate as a, o_orderdate::date + 400 as b from orders),
        f as (select *, strftime(a, '%Y-%m') as am, strftime(b, '%Y-%m') as bm, case k when 7 then strftime(a, '20%y') else strftime(a, '%Y') end as ay, case k when 7 then strftime(b, '20%y') else strftime(b, '%Y') end as by_ from d),
        x as (select o_orderkey, k, case when k in (0, 1, 4) then am when k in (3, 5, 7) then ay end as start_date,
                     case k when 1 then bm when 4 then bm when 2 then ay when 3 then by_ when 7 then by_ when 6 then am end as end_date, k in (0, 5) as is_current from f)
        select o_orderkey, start_date, end_date, is_current, case when is_current then start_date || ' - Present' else concat_ws(' - ', start_date, end_date) end as shown from x""",
    "filename_name": """
        select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || case when p_partkey % 5 = 4 then ' P M' else '' end as name,
               case when p_partkey % 10 = 0 then 'document' else p_brand || '_' || p_type || '___' end as safe from part""",
    "sections_map": "select conv_id, role, count(*) as lines, sum(length(text))::bigint as chars from conversations group by conv_id, role",
    "dictionary_tools": r"with d as (select doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}+#]+', ' ', 'g') || ' ' as p from documents) select doc_id, array_to_string(list_filter(["
    + ", ".join(f"'{t}'" for t in sorted(TERMS))
    + "], lambda t: contains(p, ' ' || t || ' ')), ',') as terms from d",
    "domain_classify": "with w as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '[ \\n]+')) as w from documents), s as (select doc_id, "
    + ", ".join("(" + " + ".join(f"case when list_contains(w, '{t}') then {x} else 0 end" for t, x in terms.items()) + f")::double as {name}" for name, terms in TAXONOMY.items())
    + " from w), g as (select *, greatest("
    + ", ".join(TAXONOMY)
    + ") as score from s) select doc_id, case when score < 2.5 then 'General' "
    + " ".join(f"when {n} = score then '{n}'" for n in TAXONOMY)
    + " end as domain, score from g",
    "ats_score": """
        with p as (select doc_id, n_chars as n, length(trim(text)) as s, len(string_split(text, chr(10))) as k from documents),
        q as (select doc_id, n, (case when n % 3 = 0 then 5 else 0 end + case when n % 2 > 0 then 5 else 0 end + case when n % 4 > 0 then 3 else 0 end + case when n % 7 > 0 then 2 else 0 end)::int as contact,
                     (case when s > 30 then 5 else 0 end + case when k >= 3 then 5 else 0 end + case when n % 3 > 0 then 5 else 0 end + case when n % 2 > 0 then 5 else 0 end + case when n % 6 > 0 then 5 else 0 end)::int as completeness,
                     case when k >= 12 then 25 when k >= 8 then 20 when k >= 4 then 15 when k >= 1 then 10 else 0 end as skills_score,
                     case when n % 3 > 0 then case when n > 800 then 10 else 0 end + case when n > 1000 then 5 else 0 end + case when n > 3000 then 10 else 0 end when n % 2 > 0 then 15 else 0 end as experience_score,
                     case when n % 5 = 0 then 5 else 10 end as formatting from p),
        r as (select *, contact + completeness + skills_score + experience_score + formatting as overall from q)
        select doc_id, contact, completeness, skills_score, experience_score, formatting, overall, case when overall >= 85 then 'A+' when overall >= 75 then 'A' when overall >= 60 then 'B' else 'C' end as grade,
               least(4, (contact >= 13)::int + (skills_score >= 20)::int + (experience_score >= 20)::int + (completeness >= 20)::int + (formatting = 10)::int) as n_strengths from r""",
}
