"""Skills, certificates, summaries, links, profile classes and experience of candidates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import scoring, skills, text
from vellumine.operators.intervals import total_experience
from vellumine.sources.tables import table

#: The word lists of the queries are words of the test texts.
WORDS = skills.Words(known=("the", "der", "les", "por"), stop=("of", "and", "de", "zu"), roles=("que", "in"), companies=("une", "la", "systems"))
TAXONOMY = {"Articles": (("the", "from", "with", "that"), ("of", "and")), "Mechanical": (("der", "eine", "und"), ("die", "den")), "Romance": (("une", "para", "dans"), ("que", "la"))}
BOOST = ("Mechanical", ("nx", "eine"), "die", 8.0)
ROLES = ("Design Engineer", "Senior Backend Developer", "QA lead", "HR", "Business Development", "Account Executive", "Structural engineer", "Electronics", "electrical", "Marketing", "Data", "poet", "")


def skills_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that each document lists or mentions, as number and digest."""
    found = table(spark, sf_dir, "documents").select("doc_id", skills.skills(F.col("text"), F.col("text"), WORDS).alias("x"))
    return found.select("doc_id", F.size("x").cast("long").alias("n_skills"), F.md5(F.array_join("x", "|")).alias("digest"))


def skill_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of every comma part of the conversations' turns, counted by turn."""
    parts = F.split("text", ",")
    good = F.filter(parts, lambda x: skills.valid_skill(x, WORDS))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(parts).cast("long").alias("n_parts"), F.size(good).cast("long").alias("n_valid"))


def certifications_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", skills.certifications(F.col("text")).alias("x"))
    return found.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


def summary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of documents: their first line as a section, and without a section."""
    t = F.col("text")
    first = skills.summary(F.substring_index(t, "\n", 1), t)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(first).alias("with_section"), F.md5(skills.summary(F.lit(None).cast("string"), t)).alias("without_section"))


def link_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", text.links(F.concat_ws(" ", "url", "html")).alias("x"))
    routed = found.select("page_id", skills.routed_links(F.col("x")).alias("r"))
    return routed.select("page_id", "r.portfolio", F.array_join("r.others", "|").alias("others"))


def profile_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile classes of documents: their words stand for skills and roles, the whole text for highlights."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("highlights"), F.split(F.lower("text"), r"[ \n]+").alias("w"))
    words = lambda first, many: F.array_join(F.slice("w", first, many), " ")
    parts = w.select("doc_id", "highlights", F.array_distinct(F.slice("w", 1, 12)).alias("skills"), words(1, 4).alias("role"), words(5, 12).alias("roles"), words(17, 8).alias("education"), words(25, 30).alias("summary"))
    return scoring.profile_domain(parts, TAXONOMY, BOOST).select("doc_id", "domain", "score")


def role_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles that roles suggest: fixture titles and the market segments of customers."""
    titles = spark.createDataFrame([(r,) for r in ROLES], "role string").unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role")))
    return titles.select("role", scoring.profile_of_role(F.col("role")).alias("profile")).groupBy("role", "profile").agg(F.count("*").alias("n"))


def experience_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience in words of each part's suppliers: line items as positions, some without months, dates or an end."""
    n, day = F.col("l_linenumber"), F.col("l_shipdate")
    until = F.add_months(day, F.col("l_quantity").cast("int"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", F.when(n == 6, F.date_format(day, "yyyy")).when(n != 7, F.date_format(day, "yyyy-MM")).alias("start_date"),
        F.when(n == 5, F.date_format(until, "yyyy")).when(n < 5, F.date_format(until, "yyyy-MM")).alias("end_date"), (n == 4).alias("is_current"),
        F.when(n == 6, "until the Present").when(n == 7, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" yrs 3 months"))).alias("duration"),
    )
    return total_experience(items, ["l_partkey", "l_suppkey"], F.lit("2003-06-15").cast("date"))


def degree_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first degree with its institution of each customer's orders, and one-line skills of the order's words."""
    some = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"), "p_type", "p_brand", "p_size")
    degrees = F.array(*[F.struct(d.alias("degree"), i.alias("institution")) for d, i in ((F.when(F.col("p_size") % 3 > 0, F.lit(" ")), F.lit("x")), (F.when(F.col("p_size") % 2 > 0, F.col("p_type")), F.col("p_brand")), (F.col("p_type"), F.lit(None).cast("string")))])
    tools = F.array(F.upper("p_type"), F.lower("p_type"), F.lit(" "), F.col("p_brand"))
    return some.select("p_partkey", skills.highest_degree(degrees).alias("degree"), skills.skills_summary(F.col("w"), tools).alias("summary"), F.get("w", F.lit(0)).alias("first_word"))


def top_skills_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent elements of JSON arrays in a five-way star: values of line items, fields, orders, customers, one nation."""
    value = F.when(F.col("p_size") % 2 == 0, F.to_json(F.split("p_name", " "))).otherwise(F.to_json(F.struct("p_name")))
    fields = table(spark, sf_dir, "part").select("p_partkey", value.alias("value")).filter(skills.is_json_array(F.col("value")))
    one = table(spark, sf_dir, "nation").filter("n_name = 'FRANCE' or n_nationkey = 3").select("n_nationkey")
    owners = table(spark, sf_dir, "customer").join(one, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    orders = table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    often = rows.groupBy("l_partkey").agg(F.count("*").alias("n")).join(fields, F.col("l_partkey") == F.col("p_partkey"))
    words = often.select(F.explode(F.from_json("value", "array<string>")).alias("term"), "n")
    return words.groupBy("term").agg(F.sum("n").alias("frequency")).orderBy(F.desc("frequency"), "term").limit(20)


def editable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of customers, reduced to the allowed fields under their own names."""
    c = F.col
    updates = F.create_map(F.lit("Full_Name "), c("c_name"), F.lit("phone"), F.concat(F.lit(" "), c("c_custkey").cast("string")), F.lit("id"), F.lit("1"), F.lit("status"), F.when(c("c_custkey") % 2 == 0, c("c_mktsegment")), F.lit("contact_no"), F.when(c("c_custkey") % 3 == 0, F.lit("last")))
    e = table(spark, sf_dir, "customer").select("c_custkey", skills.editable(updates).alias("e"))
    return e.select("c_custkey", F.size("e").cast("long").alias("n"), *[F.element_at("e", F.lit(k)).alias(k) for k in ("name", "contact_no", "status")])


QUERIES = {f.__name__: f for f in (skills_extract, skill_valid, certifications_listed, summary_pick, link_routes, profile_domain, role_fallback, experience_total, degree_highest, top_skills_star, editable_fields)}

_EDGE = r"[•*\- \t,;|" + chr(0xF0B7) + "]+"
_BREAKS = "[,;|•" + chr(0xF0B7) + r"]|\s+-\s+"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _word(words: str) -> str:
    return r"(?:^|[^\p{L}\p{N}_])(?:" + words + r")(?:$|[^\p{L}\p{N}_])"


def _valid(x: str) -> str:
    tokens = rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda q: q <> '')"
    return rf"""({x} = 'go' or {x} = 'golang' or (length({x}) between 2 and 40 and {x} not in ('of', 'and', 'de', 'zu', 'software/language', 'proficiency', 'proficiencies', 'technical skills', 'skills', 'key skills', 'languages', 'tools', 'language')
        and not (ends_with({x}, 's') and left({x}, length({x}) - 1) in ('of', 'and', 'de', 'zu')) and regexp_matches({x}, '\p{{L}}') and len({tokens}) <= 4
        and ({x} in ('the', 'der', 'les', 'por') or not (list_has_any({tokens}, ['que', 'in', 'une', 'la']) or regexp_matches({x}, 'manager|engineer|analyst|specialist|developer|lead|officer|trainee|consultant')
        or regexp_matches({x}, '{_word("ltd|pvt|limited|corp|inc|technologies|industries|solutions|india|bridgestone|wipro")}')
        or regexp_matches({x}, 'january|february|march|april|may|june|july|august|september|october|november|december|present|current') or regexp_matches({x}, '{_word("(?:19|20)[0-9]{2}")}')))))"""


def _items(name: str, lines: str) -> str:
    """CTE `name` (doc_id, x, o): valid items of the lines (doc_id, pos, line) in order."""
    return rf"""{name}p as (select doc_id, pos, unnest(y) as part, generate_subscripts(y, 1) as k from (select doc_id, pos, regexp_split_to_array(line, '{_BREAKS}') as y from {lines})),
        {name}c as (select doc_id, pos, k, regexp_replace(part, '^{_EDGE}|{_EDGE}$', '', 'g') as c from {name}p),
        {name}i as (select doc_id, pos, k, unnest(y) as x, generate_subscripts(y, 1) as j from (select doc_id, pos, k, list_concat(flatten(list_transform(regexp_extract_all(c, '\((.*?)\)', 1),
            lambda z: list_transform(regexp_split_to_array(z, '[,;/|•]'), lambda u: {_trim('u')}))), [{_trim(r"regexp_replace(c, '\(.*?\)', '', 'g')")}]) as y from {name}c)),
        {name} as (select doc_id, x, pos * 1000000000::bigint + k * 1000 + j as o from {name}i where {_valid("lower(x)").replace("lower(x) = 'go'", "x = 'Go'", 1)})"""


def _points(column: str, terms: tuple[str, ...], n: float) -> str:
    return " + ".join(f"case when regexp_matches({column}, '{_word(t)}') then {n} else 0 end" for t in terms)


def _domain(skill_terms: tuple[str, ...], role_terms: tuple[str, ...], more: str = "0") -> str:
    long = tuple(t for t in skill_terms if len(t) > 3)
    equal, part = ", ".join(f"'{t}'" for t in skill_terms), " or ".join(f"contains(s, '{t}')" for t in long)
    return f"""(3 * len(list_filter(skills, lambda s: s in ({equal}) or {part})) + {_points("roles", role_terms, 5)} + {_points("role", role_terms, 6)} + {_points("education", role_terms, 3.5)}
        + {_points("highlights", long, 1.5)} + {_points("summary", long, 1)} + {more})::double"""


_PROFILE = """case when regexp_matches(r, 'mechanical|design') then 'Mechanical' when regexp_matches(r, 'software|developer|frontend|backend') then 'Software' when regexp_matches(r, 'civil|structural') then 'Civil'
        when contains(r, 'electrical') then 'Electrical' when regexp_matches(r, 'electronics|embedded') then 'Electronics' when regexp_matches(r, 'data|analyst') then 'Data Science' when regexp_matches(r, 'account|finance') then 'Finance'
        when regexp_matches(r, 'hr|recruiter') then 'Human Resources' when regexp_matches(r, 'sales|business development') then 'Sales' when contains(r, 'marketing') then 'Marketing' when regexp_matches(r, 'quality|qa') then 'Quality' else 'General' end"""

ORACLES = {
    "skills_extract": rf"""
        with l as (select doc_id, pos, regexp_replace(line, '^{_EDGE}|{_EDGE}$', '', 'g') as line from (select doc_id, unnest(y) as line, generate_subscripts(y, 1) as pos from (select doc_id, string_split(text, chr(10)) as y from documents))),
        r as (select doc_id, pos, case when b = '' then line else b end as line from (select *, {_trim(r"regexp_replace(line, '^(?:[A-Za-z\s/&]+|[0-9]+[.)])\s*:\s*', '')")} as b from l where line <> '' and length(line) <= 2500)),
        {_items("a", "r")},
        m as (select doc_id, pos, regexp_extract(line, '(?i)^(?:technical\s+skills|core\s+competencies|key\s+skills|technologies|tech\s+stack|tools|skillset|programming\s+languages|frameworks|databases|cloud|platforms|libraries)[\s:]+(.*)', 1) as line from l where length(line) <= 160),
        {_items("f", "(select * from m where line <> '')")},
        n as (select doc_id, count(distinct lower(x)) as n from a group by doc_id),
        t as (select doc_id, unnest(case when n.n >= 3 then [] else [1] end) as few from documents left join n using (doc_id)),
        d as (select doc_id, k, o from documents, (values ('the', 1), ('der', 2), ('les', 3), ('por', 4)) as w(k, o) where regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_])' || k || '(?:$|[^\p{{L}}\p{{N}}_])')),
        u as (select doc_id, x, o from a union all select doc_id, x, o + 100000000000000000 from f where doc_id in (select doc_id from t) union all select doc_id, upper(k[1]) || k[2:], o + 200000000000000000 from d),
        g as (select doc_id, arg_min(x, o) as x, min(o) as o from u group by doc_id, lower(x)),
        h as (select doc_id, count(*) as n, string_agg(x, '|' order by o) as x from g group by doc_id)
        select doc_id, coalesce(n, 0)::bigint as n_skills, md5(coalesce(x, '')) as digest from documents left join h using (doc_id)""",
    "skill_valid": rf"""with p as (select conv_id, turn, list_transform(string_split(text, ','), lambda v: {_trim('v')}) as p from conversations)
        select conv_id, turn, len(p)::bigint as n_parts, len(list_filter(p, lambda v: v = 'Go' or (v <> 'go' and {_valid("lower(v)").replace("lower(v) = 'go' or ", "", 1)}) or (v = 'go')))::bigint as n_valid from p""",
    "certifications_listed": rf"""with c as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda v: {_trim(r"regexp_replace(v, '^[•\-* \t]+', '')")}),
        lambda v: length(v) >= 4 and lower(v) not in ('certifications', 'certificates', 'courses', 'achievements')) as x from documents) select doc_id, len(x)::bigint as n, md5(array_to_string(x, '|')) as digest from c""",
    "summary_pick": rf"""
        with l as (select doc_id, {_trim(r"regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')")} as s, list_filter(list_transform(string_split(text, chr(10)), lambda v: {_trim('v')}), lambda v: v <> '')[2:8] as x from documents),
        g as (select doc_id, s, list_filter(x, lambda v: not regexp_matches(v, '(?i)[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9-.]+|(?:\+?91[\s-]?)?[6-9]\d{{4}}[\s-]?\d{{5}}|(?:\+?\d{{1,3}}[-.\s]?)?\(?\d{{3}}\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}}|0?[6-9]\d{{9}}|https?://[-a-z0-9@:%._+~#=]{{1,256}}\.[a-z0-9()]{{1,6}}\b|linkedin[.]com/|github[.]com/')
            and left(v, 1) not in ('-', '•', '*', '{chr(0xF0B7)}') and len(regexp_split_to_array(v, '\s+')) >= 6 and length(v) between 35 and 600) as x from l),
        c as (select doc_id, s, list_filter(list_transform(x, lambda v: nullif(regexp_replace(regexp_replace(regexp_replace(v, '[*_`#]+', '', 'g'), '\s+', ' ', 'g'), '^[\s,;:|\-]+|[\s,;:|\-]+$', '', 'g'), '')), lambda v: v is not null and not starts_with(lower(v), 'curriculum'))[1] as f from g)
        select doc_id, md5(case when length(s) >= 20 then s else f end) as with_section, md5(f) as without_section from c""",
    "link_routes": r"""
        with e as (select page_id, list_transform(regexp_extract_all(concat_ws(' ', url, html), '(?i)https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_+.~#?&/=]*'), lambda x: regexp_replace(x, '[.,;)]+$', '')) as x from pages),
        u as (select page_id, list_filter(x, lambda v, i: list_position(x, v) = i and not regexp_matches(lower(v), 'linkedin[.]com|linkiedin[.]com|github[.]com')) as x from e),
        p as (select page_id, x, list_filter(x, lambda v: regexp_matches(lower(v), 'portfolio|github[.]io|vercel[.]app|netlify[.]app|me[.]'))[1] as portfolio from u)
        select page_id, portfolio, array_to_string(list_filter(x, lambda v: v is distinct from portfolio), '|') as others from p""",
    "profile_domain": f"""
        with w as (select doc_id, lower(text) as highlights, regexp_split_to_array(lower(text), '[ \\n]+') as w from documents),
        p as (select doc_id, highlights, list_distinct(w[1:12]) as skills, array_to_string(w[1:4], ' ') as role, array_to_string(w[5:16], ' ') as roles, array_to_string(w[17:24], ' ') as education, array_to_string(w[25:54], ' ') as summary from w),
        s as (select *, {_domain(("the", "from", "with", "that"), ("of", "and"))} as a,
            {_domain(("der", "eine", "und"), ("die", "den"), "case when (len(list_filter(skills, lambda s: contains(s, 'nx') or contains(s, 'eine'))) > 0 or contains(highlights, 'nx') or contains(highlights, 'eine')) and (contains(role, 'die') or contains(roles, 'die')) then 8 else 0 end")} as b,
            {_domain(("une", "para", "dans"), ("que", "la"))} as c, role as r from p)
        select doc_id, case when greatest(a, b, c) < 2.5 then {_PROFILE} when a >= b and a >= c then 'Articles' when b >= c then 'Mechanical' else 'Romance' end as domain, greatest(a, b, c) as score from s""",
    "role_fallback": f"""with t as (select unnest([{", ".join(f"'{r}'" for r in ROLES)}]) as role union all select c_mktsegment from customer), p as (select role, lower(role) as r from t)
        select role, {_PROFILE} as profile, count(*) as n from p group by all""",
    "experience_total": """
        with i as (select l_partkey, l_suppkey, l_linenumber as n, year(l_shipdate) as y, month(l_shipdate) as m, l_quantity::int as q from lineitem),
        s as (select l_partkey, l_suppkey, case when n = 6 then y * 12 + 1 when n <> 7 then y * 12 + m end as s,
            case when n in (4, 6) then 2003 * 12 + 6 when n = 5 then ((y * 12 + m - 1 + q) // 12) * 12 + 12 when n < 5 then y * 12 + m + q end as e, case when n = 7 then q * 12 + 3 end as d from i),
        v as (select l_partkey, l_suppkey, case when e >= s then s when d > 0 then 0 end as s, case when e >= s then e when d > 0 then d end as e from s),
        o as (select *, max(e) over (partition by l_partkey, l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as b from v where s is not null),
        c as (select l_partkey, l_suppkey, sum(greatest(0, e - greatest(s, coalesce(b, s)))) as c from o group by all),
        k as (select distinct l_partkey, l_suppkey from lineitem)
        select l_partkey, l_suppkey, case when c <= 0 then null when c < 12 then c::bigint || ' Months' when c % 12 >= 2 then (c // 12)::bigint || 'y ' || (c % 12)::bigint || 'm' when c > 0 then (c // 12)::bigint || ' Years' end as experience
        from k left join c using (l_partkey, l_suppkey)""",
    "degree_highest": """
        with p as (select *, string_split(p_name, ' ') || [upper(p_type), lower(p_type), p_brand] as w from part)
        select p_partkey, case when p_size % 2 > 0 then p_type || ' - ' || p_brand else p_type end as degree,
            array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ', ') as summary, w[1] as first_word from p""",
    "top_skills_star": """
        with f as (select p_partkey, case when p_size % 2 = 0 then to_json(string_split(p_name, ' ')) else to_json({'p_name': p_name}) end as value from part),
        x as (select unnest(from_json(value, '["VARCHAR"]')) as term from lineitem join f on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            where (n_name = 'FRANCE' or n_nationkey = 3) and json_type(value) = 'ARRAY')
        select term, count(*) as frequency from x group by term order by frequency desc, term limit 20""",
    "editable_fields": """
        select c_custkey, (2 + (c_custkey % 2 = 0)::int)::bigint as n, trim(c_name) as name, case when c_custkey % 3 = 0 then 'last' else c_custkey::varchar end as contact_no, case when c_custkey % 2 = 0 then trim(c_mktsegment) end as status from customer""",
}
