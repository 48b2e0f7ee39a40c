"""Positions and degrees read from texts. The words of every document are dealt into blocks of 20, each written as a
position or a degree in one of several layouts; the SQL writes down what each layout says instead of reading it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions.degrees import degrees
from vellumine.functions.positions import positions
from vellumine.functions.skills import Words
from vellumine.sources.tables import table

WORDS = Words(roles=("engineer", "developer", "analyst", "manager"), companies=("ltd", "labs", "solutions", "pvt"), places=("pune", "india"))

#: Words of texts: three letters or more, without any that the vocabulary itself would find in them.
WORD, SPECIAL = r"\p{L}{3,}", (
    "(?i)inc|corp|ltd|llc|pvt|tech|solut|serv|consult|engin|develop|analy|manag|motor|group|ventur|enter|indust|bank|steel|limit|hold|prod|lab|ansa|ansys|creo|adam|primer|prepar|anim|nx|degree|none"
)
BLOCK = 20


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the array of all blocks of words."""
    special = "(?i)" + L.any_of(tuple(SPECIAL.removeprefix("(?i)").split("|")))
    found = F.filter(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: ~w.rlike(special))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(found, lambda w: F.concat(w, F.lit("q"))).alias("w"))
    starts = F.filter(F.transform("w", lambda x, i: F.when(i % BLOCK == 0, i)), lambda i: i.isNotNull())
    return docs.select("doc_id", F.transform(starts, lambda i: F.slice("w", i + 1, BLOCK)).alias("parts"))


def _word(b: Column, k: int) -> Column:
    return F.coalesce(F.get(b, F.lit(k)), F.lit("nilq"))


def _position(b: Column, k: Column) -> Column:
    a, c, place, note = (_word(b, i) for i in range(4))
    more = F.array_join(F.slice(b, 5, BLOCK), " ")
    year = lambda n: (F.lit(1990 + n) + k % 20).cast("string")
    layouts = (
        (F.concat(a, F.lit(" engineer at "), c, F.lit(" ltd, "), place), F.concat(F.lit("Jan "), year(0), F.lit(" - Mar "), year(1)), F.concat(F.lit("- "), note), F.concat(F.lit("- "), more)),
        (F.concat(a, F.lit(" developer")), F.concat(c, F.lit(" solutions")), F.concat(F.lit("05/"), year(0), F.lit(" – "), year(2)), F.concat(F.lit("• "), note), F.concat(F.lit("• "), more)),
        (F.concat(a, F.lit(" pvt ltd | "), c, F.lit(" analyst | pune "), year(0), F.lit(" to Present")), F.concat(F.lit("* "), note), F.concat(F.lit("* "), more)),
        (F.concat(a, F.lit(" manager ("), c, F.lit(" labs, "), place, F.lit(")")), F.concat(F.lit("from "), year(0), F.lit(" till "), year(1)), F.concat(F.lit("-"), note), F.concat(F.lit("-"), more)),
    )
    return F.get(F.array(*[F.concat_ws("\n", *x) for x in layouts]), (k % 4).cast("int"))


def experience_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(spark, sf_dir).select("doc_id", F.array_join(F.transform("parts", _position), "\n").alias("part"))
    return positions(docs, "doc_id", "part", WORDS).select(
        "doc_id", F.col("number").cast("long").alias("number"), "role", "company", "location", "duration", "start_date", "end_date", "is_current", F.array_join("highlights", "|").alias("highlights")
    )


def _degree(b: Column, k: Column) -> Column:
    mark = F.concat(F.lit("v"), k.cast("string"), F.lit("v"))
    a, c, other = F.concat(_word(b, 0), mark), F.concat(_word(b, 1), mark), _word(b, 2)
    year = lambda n: (F.lit(1990 + n) + k % 20).cast("string")
    layouts = (
        F.concat(F.lit("B.Tech in "), a, F.lit(" | "), c, F.lit(" University | "), year(0), F.lit("-"), year(4), F.lit(" | CGPA: 8."), (k % 10).cast("string")),
        F.concat(F.lit("MBA, "), a, F.lit(" College, "), year(0), F.lit(", 7"), (k % 10).cast("string"), F.lit("%")),
        F.concat(F.lit("Diploma "), a, F.lit("\n"), c, F.lit(" School, Jan "), year(0), F.lit(" - Feb "), year(1), F.lit("\nDiploma "), a, F.lit(" "), other),
        F.concat(F.lit("M.Sc:- "), a, F.lit("\nEngineering\n"), c, F.lit(" Institute\n"), year(0)),
    )
    return F.get(F.array(*layouts), (k % 4).cast("int"))


def education_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As experience_blocks; the first two words of each document also make a misplaced degree outside the part."""
    lost = F.concat(F.lit("about\n"), _word(F.get("parts", F.lit(0)), 3), F.lit(" Polytechnic of "), _word(F.get("parts", F.lit(0)), 4), F.lit(" - Bachelor of Letters, 2001 - 2004, First Division\nend"))
    docs = _dealt(spark, sf_dir).select("doc_id", F.array_join(F.transform("parts", _degree), "\n").alias("part"), lost.alias("whole"))
    out = degrees(docs, "doc_id", "part", WORDS, "whole")
    return out.select("doc_id", F.col("number").cast("long").alias("number"), "degree", "institution", "duration", "start_date", "end_date", "details")


QUERIES = {f.__name__: f for f in (experience_blocks, education_blocks)}

_DEALT = rf"""
    w as (select doc_id, list_transform(list_filter(regexp_extract_all(text, '{WORD}'), lambda x: not regexp_matches(x, '{SPECIAL}')), lambda x: x || 'q') as w from documents),
    b as (select doc_id, k::bigint as k, w[{BLOCK} * k + 1:{BLOCK} * k + {BLOCK}] as b from (select doc_id, w, unnest(range(0, (len(w) + {BLOCK - 1}) // {BLOCK})) as k from w)),
    v as (select *, coalesce(b[1], 'nilq') as w1, coalesce(b[2], 'nilq') as w2, coalesce(b[3], 'nilq') as w3, coalesce(b[4], 'nilq') as w4, nullif(array_to_string(b[5:], ' '), '') as more,
                 'v' || k || 'v' as mark, 1990 + k % 20 as y from b)"""

ORACLES = {
    "experience_blocks": rf"""
        with {_DEALT}
        select doc_id, k + 1 as number,
               case k % 4 when 0 then w1 || ' engineer' when 1 then w1 || ' developer' when 2 then w2 || ' analyst' else w1 || ' manager' end as role,
               case k % 4 when 0 then w2 || ' ltd' when 1 then w2 || ' solutions' when 2 then w1 || ' pvt ltd' else w2 || ' labs' end as company,
               case k % 4 when 1 then null when 2 then 'pune' else w3 end as location,
               case k % 4 when 0 then y || '-01 - ' || y + 1 || '-03' when 1 then y || '-05 - ' || y + 2 when 2 then y || ' - Present' else y || ' - ' || y + 1 end as duration,
               case k % 4 when 0 then y || '-01' when 1 then y || '-05' else y::varchar end as start_date,
               case k % 4 when 0 then y + 1 || '-03' when 1 then (y + 2)::varchar when 2 then null else (y + 1)::varchar end as end_date,
               k % 4 = 2 as is_current, concat_ws('|', w4, more) as highlights
        from v""",
    "education_blocks": rf"""
        with {_DEALT},
        o as (select doc_id, k + 2 as number,
               case k % 4 when 0 then 'B.Tech in ' || w1 || mark when 1 then 'MBA' when 2 then 'Diploma ' || w1 || mark || ' ' || w3 else 'M.Sc - ' || w1 || mark || ' Engineering' end as degree,
               case k % 4 when 0 then w2 || mark || ' University' when 1 then w1 || mark || ' College' when 2 then w2 || mark || ' School' else w2 || mark || ' Institute' end as institution,
               case k % 4 when 0 then y || ' - ' || y + 4 when 2 then y || '-01 - ' || y + 1 || '-02' else y::varchar end as duration,
               case k % 4 when 0 then y::varchar when 2 then y || '-01' end as start_date,
               case k % 4 when 0 then (y + 4)::varchar when 2 then y + 1 || '-02' else y::varchar end as end_date,
               case k % 4 when 0 then 'CGPA: 8.' || k % 10 when 1 then '7' || k % 10 || '%' end as details
             from v)
        select * from o
        union all
        select doc_id, 1, 'Bachelor of Letters', coalesce(w[4], 'nilq') || ' Polytechnic of ' || coalesce(w[5], 'nilq'), '2001 - 2004', '2001', '2004', 'First Division' from w""",
}
