"""Order-dependent text operators over the driver's tables, and geometry over small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import geometry, markup, parsing
from vellumine.sources.tables import table


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.visible_text(F.col("html")).alias("text"))


def lines_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are broken after every seventh word, every other one under a bullet, stitched again."""
    broken = F.regexp_replace("text", r"((?:[^ \n]+ ){7})", "$1\n")
    lines = F.transform(F.split(broken, "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("- "), x)).otherwise(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).withColumn("x", markup.stitched(F.col("l"), ("the",), ("und",)))
    return docs.select("doc_id", F.size("l").alias("before"), F.size("x").alias("after"), F.md5(F.array_join("x", "\n")).alias("digest"))


def skill_fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), "[ \n]+"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(parsing.fuzzy_distinct_of(words), " ").alias("kept"))


def sections_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text with its roles as headers, cut into sections again."""
    header = F.create_map(F.lit("user"), F.lit("Summary:"), F.lit("assistant"), F.lit("Experience:"), F.lit("system"), F.lit("Skills:"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.element_at(header, F.col("role")), F.lit("\n"), "text").alias("t")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))
    return whole.select("conv_id", F.explode(markup.sections(F.col("text"))).alias("section", "text")).select("conv_id", "section", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def page_size_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: sizes around the standard ones and off them, upright and turned."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    base = lambda i: F.get(F.array(*[F.lit(float(x[i])) for x in geometry.PAGE_SIZES.values()]), (k % len(geometry.PAGE_SIZES)).cast("int"))
    w, h = F.when(k % 2 == 0, base(0)).otherwise(base(1)) + s * 0.125 - 2, F.when(k % 2 == 0, base(1)).otherwise(base(0)) - s * 0.0625
    size = F.array_join(geometry.page_size(w, h).cast("array<string>"), "x")
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), geometry.coordinate(w).alias("x"), geometry.shape_kind(s, s * 2).alias("kind"))


def text_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", geometry.text_width(F.col("p_name"), F.col("p_size").cast("double"), F.col("p_size") > 25).alias("width"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", geometry.hex_colour(k % 256, (k * 7) % 256, F.when(k % 3 == 0, 17).otherwise(k % 200)).alias("colour"))


QUERIES = {f.__name__: f for f in (html_clean, lines_stitched, skill_fuzzy_dedup, sections_found, page_size_snap, text_width, colours)}

_SIZES = "[[595, 842], [842, 595], [612, 792], [792, 612], [612, 1008], [1008, 612], [842, 1191], [1191, 842], [420, 595], [595, 420]]"
ORACLES = {
    "html_clean": r"""
        with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g') as t from pages),
        b as (select page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g') as t from a),
        c as (select page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|br|div|li|tr|h1|h2|h3|h4|section|article|footer|nav|ul)(\s[^>]*)?/?>', chr(10), 'g'), '</?[A-Za-z][^>]*>', '', 'g') as t from b),
        d as (select page_id, replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') as t from c)
        select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from d""",
    "lines_stitched": rf"""
        with recursive d as (select doc_id, string_split(regexp_replace(text, '((?:[^ \n]+ ){{7}})', '\1' || chr(10), 'g'), chr(10)) as l from documents),
        e as (select doc_id, i, regexp_replace(case when i % 4 = 0 then '- ' || x else x end, '^\s+|\s+$', '', 'g') as x, n from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as i, len(l) as n from d)),
        w as (select *, len(list_filter(string_split_regex(x, '\s+'), lambda v: v <> '')) as k, regexp_matches(x, '^[-*] ') as bullet, trim(lower(x), ' :') in ('{"', '".join(markup.SECTION_WORDS)}') as header,
                     regexp_matches(x, '(?i)\b(19|20)[0-9]{{2}}\b|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.]?,?\s*[0-9]{{4}}\s*([-–—~]|to|till|until)|\b[0-9]{{1,2}}[/-][0-9]{{2,4}}\s*([-–—~]|to|till|until)\s*([0-9]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|current|present|ongoing)') as dated from e),
        f as (select *, bullet or header or (x = upper(x) and x <> lower(x) and k <= 4) or (dated and k <= 6) or contains(x, '|')
                     or regexp_matches(x, '(?i)[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9-.]+|(?:\+?91[\s-]?)?[6-9]\d{{4}}[\s-]?\d{{5}}|(?:\+?\d{{1,3}}[-.\s]?)?\(?\d{{3}}\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}}|0?[6-9]\d{{9}}|https?://[-a-z0-9@:%._+~#=]{{1,256}}\.[a-z0-9()]{{1,6}}\b|(linkiedin|linkedin)\.com/in/[a-z0-9_-]|github\.com/[a-z0-9_-]') as apart,
                     regexp_matches(x, '[.:;!?]$') as closed, regexp_matches(x, '[,-]$') or lower(regexp_extract(x, '(\S+)$', 1)) in ('{"', '".join(markup.HANGING)}') as hangs,
                     regexp_matches(x, '^\p{{Ll}}') as low, contains(lower(x), 'the') as role, contains(lower(x), 'und') as company from w),
        s as (select doc_id, i, false as g, x <> '' as open, header, bullet, dated, role, closed, hangs, k::bigint as k from f where i = 0
              union all
              select doc_id, i, g, open, not g and h as header, case when g then sb else bullet end, dated or (g and sd), role or (g and sr), closed, hangs, (case when g then sk + k else k end)::bigint
              from (select f.doc_id, f.i, f.x <> '' as open, f.header as h, f.bullet, f.dated, f.role, f.closed, f.hangs, f.k, s.bullet as sb, s.dated as sd, s.role as sr, s.k as sk,
                           s.open and f.x <> '' and not f.apart and not s.closed and not s.header and not (s.dated and s.k <= 6) and not (s.role and f.company) and (s.hangs or (f.low and s.bullet)) as g
                    from s join f on f.doc_id = s.doc_id and f.i = s.i + 1)),
        m as (select doc_id, i, sum(1 - g::int) over (partition by doc_id order by i) as grp from s),
        r as (select m.doc_id, m.grp as r, string_agg(f.x, ' ' order by m.i) as x, any_value(n) as n from m join f on f.doc_id = m.doc_id and f.i = m.i group by m.doc_id, m.grp)
        select doc_id, any_value(n)::int as before, count(*)::int as after, md5(string_agg(x, chr(10) order by r)) as digest from r group by doc_id""",
    "sections_found": r"""
        with t as (select conv_id, turn, case role when 'user' then 'summary' when 'assistant' then 'experience' else 'skills' end as section,
                          array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s*([0-9]+[.)]\s*)?|\s+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '^[-=_*~\s]+$')), chr(10)) as text from conversations),
        s as (select conv_id, section, string_agg(text, chr(10) order by turn) filter (text <> '') as text from t group by all)
        select conv_id, section, length(text)::int as chars, md5(text) as digest from s where text is not null""",
    "page_size_snap": f"""
        with p as (select p_partkey, p_size, [[595, 842], [612, 792], [612, 1008], [842, 1191], [420, 595]][p_partkey % 5 + 1] as b from part),
        b as (select p_partkey, p_size, b[case when p_partkey % 2 = 0 then 1 else 2 end] + p_size * 0.125::double - 2 as w, b[case when p_partkey % 2 = 0 then 2 else 1 end] - p_size * 0.0625::double as h from p)
        select p_partkey, array_to_string(coalesce(list_filter({_SIZES}, lambda s: abs(w - s[1]) <= 3 and abs(h - s[2]) <= 3)[1], [round_even(w, 0)::int, round_even(h, 0)::int]), 'x') as size,
               case when abs(w - round(w)) <= 0.05 then round(w)::bigint::varchar else printf('%.1f', round(w, 1)) end as x, case when p_size <= 4 then 'line' else 'rectangle' end as kind from b""",
    "text_width": r"""
        with c as (select p_partkey, p_size::double as s, length(p_name) as n, len(regexp_extract_all(p_name, '[iljtf.,;:''|!()\[\] ]')) as narrow, len(regexp_extract_all(p_name, '[mwMW@%]')) as wide,
                          len(regexp_extract_all(p_name, '[A-LN-VX-Z]')) as upper from part)
        select p_partkey, round((narrow * 0.3::double + wide * 0.85::double + upper * 0.65::double + (n - narrow - wide - upper) * 0.5::double) * s * case when s > 25 then 1.08::double else 1.0::double end, 2) as width from c""",
    "colours": r"""
        with c as (select p_partkey, lower(printf('%02x%02x%02x', p_partkey % 256, (p_partkey * 7) % 256, case when p_partkey % 3 = 0 then 17 else p_partkey % 200 end)) as x from part)
        select p_partkey, '#' || case when x[1] = x[2] and x[3] = x[4] and x[5] = x[6] then x[1] || x[3] || x[5] else x end as colour from c""",
}
