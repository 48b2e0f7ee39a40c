"""Details, edits and statistics over the driver's tables: nations as projects, customers as documents, orders as versions of
them, line items as values, parts as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import records
from vellumine.sources.tables import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_name", F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("status"), (F.col("c_acctbal") < 0).alias("is_deleted"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; those of status P count as deleted."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_totalprice").alias("confidence"), (F.col("o_orderstatus") == "P").alias("is_deleted"))


def document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of the live documents of the building trade."""
    docs = _documents(spark, sf_dir).filter("status = 'BUILDING'")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("v"))
    values = lines.select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("v.l_quantity").cast("int").cast("string").alias("value"), F.col("v.l_quantity").alias("confidence"), F.col("v.l_partkey").alias("block_id"), (F.col("v.l_returnflag") == "R").alias("is_deleted"))
    blocks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block_id"), F.col("p_name").alias("text"))
    profiles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("role"), F.lit(None).cast("boolean").alias("is_deleted"))
    out = records.details(docs, _versions(spark, sf_dir), values, "document_id", "version_id", profiles, blocks)
    shown = lambda m, v: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), v(e["value"]))), ",")
    return out.select("document_id", "version_id", shown("fields", lambda v: v).alias("fields"), shown("trace", lambda v: v["text"]).alias("trace"), F.col("profile.role").alias("role"))


def profiles_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of customers' profiles, some of which have none: a name, a number and a note each."""
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    profiles = c.filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("a@b.c").alias("email"), F.lit("1").alias("contact_no"), F.col("c_mktsegment").alias("status"), *[none.alias(f) for f in ("notice_period", "current_ctc", "expected_ctc", "source")],
        F.when(F.col("c_custkey") % 2 == 0, F.lit('[{"id":"1","author":"a","text":"call","date":"2024-01-01"},{"id":"2","author":"b","text":"met","date":"2023-01-01"}]')).when(F.col("c_custkey") % 3 == 0, F.lit("met")).alias("notes"),
    )
    changes = F.create_map(F.lit("Full_Name"), F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("1 ")), F.lit("phone"), F.when(F.col("c_custkey") % 5 == 0, F.lit("77")), F.lit("remarks"), F.when(F.col("c_custkey") % 7 < 4, F.lit(" call ")), F.lit("id"), F.lit("9"))
    updates = c.filter("c_nationkey < 20").select(F.col("c_custkey").alias("id"), changes.alias("changes"), F.when(F.col("c_custkey") % 2 == 0, F.lit("z")).alias("author"))
    out = records.edited(profiles, updates, "id", F.lit("2024-03-01"))
    texts = F.transform(F.from_json("notes", "array<struct<author:string,text:string,date:string>>"), lambda n: F.concat_ws("/", n["author"], n["text"], n["date"]))
    plain = F.when(F.startswith("notes", F.lit("[")), F.array_join(texts, "|")).otherwise(F.col("notes"))
    return out.select("id", "name", "email", "contact_no", "status", plain.alias("notes"), "found", F.array_join("changed", ",").alias("changed"))


def project_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    out = records.project_statistics(projects, _documents(spark, sf_dir), _versions(spark, sf_dir), "document_id", "version_id", ("BUILDING", "MACHINERY"))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 2))


QUERIES = {f.__name__: f for f in (document_details, profiles_edited, project_statistics)}

ORACLES = {
    "document_details": """
        with d as (select c_custkey as document_id from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 0),
        v as (select o_custkey as document_id, max(o_orderkey) filter (o_orderstatus <> 'P') as version_id, arg_max(o_orderpriority, o_orderkey) as role from orders group by o_custkey),
        l as (select l_orderkey, l_linenumber, min(struct_pack(p := l_partkey, q := l_quantity, f := l_returnflag)) as v from lineitem group by all),
        w as (select l_orderkey, string_agg('f' || l_linenumber || '=' || v.q::int, ',' order by 'f' || l_linenumber) as fields, string_agg('f' || l_linenumber || '=' || p_name, ',' order by 'f' || l_linenumber) as trace
              from l join part on v.p = p_partkey where v.f <> 'R' group by l_orderkey)
        select d.document_id, version_id, fields, trace, role from d left join v using (document_id) left join w on l_orderkey = version_id""",
    "profiles_edited": """
        with c as (select *, c_custkey as id, c_acctbal >= 0 as found, c_custkey % 7 < 4 as noted from customer where c_nationkey < 20),
        n as (select *, case when c_custkey % 2 = 0 then 'z' else 'system' end || '/call/2024-03-01' as new from c)
        select id, upper(c_mktsegment) || '1' as name, case when found then 'a@b.c' end as email, case when id % 5 = 0 then '77' when found then '1' end as contact_no, case when found then c_mktsegment end as status,
               case when found and id % 2 = 0 and noted then new || '|b/met/2023-01-01' when found and id % 2 = 0 then 'a/call/2024-01-01|b/met/2023-01-01'
                    when found and id % 3 = 0 and noted then new || '|system/met/2024-03-01' when found and id % 3 = 0 then 'met' when noted then new end as notes,
               found, concat_ws(',', case when id % 5 = 0 then 'contact_no' end, 'name', case when noted then 'notes' end) as changed from n""",
    "project_statistics": """
        with v as (select o_custkey, count(*) as n, sum(o_totalprice) as s from orders where o_orderstatus <> 'P' group by o_custkey)
        select n_nationkey as project_id, n_name as name, count(c_custkey) as documents, count(*) filter (c_mktsegment = 'BUILDING') as status_building, count(*) filter (c_mktsegment = 'MACHINERY') as status_machinery,
               coalesce(sum(n), 0)::bigint as versions, round(sum(s) / nullif(sum(n), 0), 2) as mean_confidence
        from nation left join customer on c_nationkey = n_nationkey and c_acctbal >= 0 left join v on o_custkey = c_custkey group by all""",
}
