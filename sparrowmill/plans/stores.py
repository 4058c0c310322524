"""What is kept up batch by batch: a history of hashes, quarterly aggregates; and what tables must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.operators.catalogue import AGE_GROUPS, DISPUTE_STATES, DISPUTE_TYPES, FRAUD_OUTCOMES, SOURCE_TYPES, constraints
from sparrowmill.operators.constraints import broken
from sparrowmill.operators.history import HashHistory
from sparrowmill.plans.standard import _FOUND, _hashed, _q
from sparrowmill.plans.views import AGG, ER, facts, unsuspected, usable
from sparrowmill.storage import shared_dir, table, written
from sparrowmill.streaming.aggregates import QuarterlyAggregates

BATCHES = 3
_ORDER = ["order_id", "contaminant_id", "part_id", "lab_id", "amount"]


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def duplicates_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Findings in three batches, each flagged against the history of those before and then entered in it."""
    rows = _hashed(facts(spark, d, flags=False), True)
    history, out = HashHistory(spark, _place(spark, "history")), None
    for n in range(BATCHES):
        batch = written(rows.where(F.col("order_id") % BATCHES == n), "batch")
        flagged = written(history.flag(batch, _ORDER), "flagged")
        history.add(batch)
        out = flagged if out is None else out.unionByName(flagged)
    return out


def aggregates_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly aggregates kept up by a stream over files of results, a few files a batch."""
    rows = facts(spark, d).select("district_id", "commodity", "test_date", "pass_fail", "confidence_score", "fraud_score", "is_duplicate", (F.col("order_id") % BATCHES).alias("part"))
    stored = written(rows, "results", ["part"])
    folder = {f.rpartition("/part=")[0] for f in stored.inputFiles()}.pop()
    kept = QuarterlyAggregates(spark, _place(spark, "aggregates"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-len(stored.inputFiles()) // BATCHES))).parquet(folder)
    kept.follow(stream, usable() & unsuspected(), _place(spark, "state"))
    return kept.current()


# -- constraints: tables of the warehouse made of the given ones, with breaches in them --


def _tables(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    t = lambda name: table(spark, d, name)
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))
    parents = {
        "labs": t("supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("id")),
        "districts": t("nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("id")),
        "brands": t("part").where("p_size < 50").select(F.substring_index("p_brand", "#", -1).cast("long").alias("id")),
        "nodes": t("nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id")).union(t("supplier").select((F.col("s_suppkey") + 10000).cast("long"))),
    }
    er = facts(spark, d, flags=False)
    records = er.select(
        F.concat_ws("-", "order_id", "contaminant_id", "part_id", "lab_id", "amount").alias("row"), pick((*SOURCE_TYPES, "blog"), F.col("contaminant_id")).alias("source_type"), F.when(F.col("order_id") % 50 != 0, F.col("commodity")).alias("commodity_id"),
        "contaminant_id", (F.col("confidence_score") - F.when(F.col("order_id") % 40 == 0, 1).otherwise(0)).alias("confidence_score"), "lab_id", "district_id", F.substring_index("brand", "#", -1).cast("long").alias("brand_id"),
        F.when(F.col("part_id") % 6 == 0, pick((*FRAUD_OUTCOMES, "maybe"), F.col("order_id"))).alias("review_outcome"),
    )
    edges = t("supplier").select(F.col("s_suppkey").cast("string").alias("row"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 9 == 0, 2000).otherwise(1000)).cast("long").alias("source"), F.when(F.col("s_suppkey") % 8 != 0, F.col("s_suppkey") + F.when(F.col("s_suppkey") % 7 == 0, 90000).otherwise(10000)).cast("long").alias("target"))
    edges = edges.unionByName(t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("row"), (F.col("n_nationkey") + 1000).cast("long").alias("source"), (F.col("n_nationkey") + 1000).cast("long").alias("target")))
    disputes = t("events").select(F.col("event_id").cast("string").alias("row"), F.col("user_id").alias("brand_id"), pick((*DISPUTE_STATES, "lost"), F.col("event_id")).alias("status"), pick((*DISPUTE_TYPES, "typo"), F.col("user_id")).alias("dispute_type"))
    users = t("customer").select(F.col("c_custkey").cast("string").alias("row"), F.when(F.col("c_custkey") % 5 > 0, F.concat((F.col("c_custkey") - F.when(F.col("c_custkey") % 30 == 7, 1).otherwise(0)).cast("string"), F.lit("@x.com"))).alias("email"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 1000).cast("string")).alias("phone"), F.lit("fmcg").alias("tier"), F.col("c_nationkey").alias("home_district_id"))
    eaten = t("part").select(F.col("p_partkey").cast("string").alias("row"), F.col("p_type").alias("commodity_id"), F.col("p_brand").alias("state"), pick((*AGE_GROUPS, "infant"), F.col("p_partkey")).alias("age_group"), F.lit("all").alias("sex"), F.col("p_size").alias("source_year"))
    return parents, {"records": records, "edges": edges, "disputes": disputes, "users": users, "consumption": eaten}


def constraints_broken(spark: SparkSession, d: str) -> DataFrame:
    """Rows of five tables that break constraints, with the names of those."""
    parents, tables = _tables(spark, d)
    out = None
    for name, rows in tables.items():
        bad = broken(rows, constraints(name, parents)).where("size(broken) > 0").select(F.lit(name).alias("table_name"), "row", F.array_join("broken", ",").alias("broken"))
        out = bad if out is None else out.unionByName(bad)
    return out


QUERIES = {f.__name__: f for f in (duplicates_by_batch, aggregates_by_batch, constraints_broken)}

_IN = lambda column, values: f"{column} in ({', '.join(map(_q, values))})"
_OF = lambda values, key: "[" + ", ".join(map(_q, values)) + f"][{key} % {len(values)} + 1]"
_SAID = lambda pairs: "concat_ws(',', " + ", ".join(f"case when {bad} then '{name}' end" for name, bad in pairs) + ")"

ORACLES = {
    "duplicates_by_batch": f"with {ER}, {_FOUND} select *, row_number() over (partition by hash order by order_id % {BATCHES}, {', '.join(_ORDER)}) > 1 as is_duplicate from h",
    "aggregates_by_batch": f"with {ER}, {AGG} select * from agg",
    "constraints_broken": f"""with {ER}, br as (select distinct split_part(p_brand, '#', 2)::bigint as id from part where p_size < 50), nd as (select n_nationkey + 1000 as id from nation union all select s_suppkey + 10000 from supplier),
r as (select concat_ws('-', order_id, contaminant_id, part_id, lab_id, amount) as row, {_OF((*SOURCE_TYPES, 'blog'), 'contaminant_id')} as st, case when order_id % 50 <> 0 then commodity end as c, confidence_score - case when order_id % 40 = 0 then 1 else 0 end as cs, lab_id, district_id,
  split_part(brand, '#', 2)::bigint as b, case when part_id % 6 = 0 then {_OF((*FRAUD_OUTCOMES, 'maybe'), 'order_id')} end as ro from er),
e as (select s_suppkey::varchar as row, s_nationkey + case when s_suppkey % 9 = 0 then 2000 else 1000 end as s, case when s_suppkey % 8 <> 0 then s_suppkey + case when s_suppkey % 7 = 0 then 90000 else 10000 end end as t from supplier union all select 'n' || n_nationkey, n_nationkey + 1000, n_nationkey + 1000 from nation),
u as (select c_custkey::varchar as row, case when c_custkey % 5 > 0 then (c_custkey - case when c_custkey % 30 = 7 then 1 else 0 end) || '@x.com' end as em, case when c_custkey % 3 > 0 then (c_custkey % 1000)::varchar end as ph, c_nationkey as n from customer),
x as (select 'records' as table_name, row, {_SAID([('commodity_id_required', 'c is null'), ('source_type_value', f"not {_IN('st', SOURCE_TYPES)}"), ('confidence_score_range', 'cs not between 0 and 1'), ('lab_id_known', 'lab_id % 10 = 3'), ('district_id_known', 'district_id = 7'), ('brand_id_known', 'b is not null and b not in (select id from br)'), ('review_outcome_value', f"not {_IN('ro', FRAUD_OUTCOMES)}")])} as broken from r
union all select 'edges', row, {_SAID([('target_required', 't is null'), ('source_known', 's not in (select id from nd)'), ('target_known', 't not in (select id from nd)'), ('ends_differ', 's = t')])} from e
union all select 'disputes', event_id::varchar, {_SAID([('brand_id_known', 'user_id not in (select id from br)'), ('status_value', f"not {_IN(_OF((*DISPUTE_STATES, 'lost'), 'event_id'), DISPUTE_STATES)}"), ('dispute_type_value', f"not {_IN(_OF((*DISPUTE_TYPES, 'typo'), 'user_id'), DISPUTE_TYPES)}")])} from events
union all select 'users', row, {_SAID([('email_once', 'em in (select em from u group by em having count(*) > 1 and em is not null)'), ('phone_once', 'ph in (select ph from u group by ph having count(*) > 1 and ph is not null)'), ('email_or_phone', 'em is null and ph is null'), ('home_district_id_known', 'n = 7')])} from u
union all select 'consumption', p_partkey::varchar, {_SAID([('age_group_value', f"not {_IN(_OF((*AGE_GROUPS, 'infant'), 'p_partkey'), AGE_GROUPS)}"), ('commodity_id_state_age_group_sex_source_year_once', f"count(*) over (partition by p_type, p_brand, {_OF((*AGE_GROUPS, 'infant'), 'p_partkey')}, p_size) > 1")])} from part)
select * from x where broken <> ''""",
}
