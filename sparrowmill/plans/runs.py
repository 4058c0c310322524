"""A whole ingest run, laboratories' updates, names of laboratories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.operators import ingest
from sparrowmill.plans import fraud
from sparrowmill.plans.standard import _CATEGORY, _K, _KEY, _PASS, _STATE, _TIER, _UNIT, RAW, _q, raw
from sparrowmill.plans.views import ER
from sparrowmill.storage import table

NAMES = ("AFB1", " Lead (Pb) ", "cadmium", "OTA", "unknown", "", "lorsban")
LIMITS = {"aflatoxin_b1": 15.0, "lead": 2500.0, "cadmium": 30000000.0}


def _standard(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.pmod("part_id", F.lit(len(NAMES))).cast("int") + 1)
    rows = raw(spark, d).withColumn("contaminant", names).withColumn("district", F.lit("")).withColumnRenamed("food", "product_name").withColumnRenamed("verdict", "pass_fail")
    aliases = spark.createDataFrame([(n, a, c) for n, (a, c) in enumerate(L.CONTAMINANT_ALIASES.items())], "rank int, alias string, canonical string")
    limits = spark.createDataFrame(list(LIMITS.items()), "contaminant string, limit_ppb double")
    return ingest.standardise(rows, aliases, limits, list(_KEY))


def standardised_records(spark: SparkSession, d: str) -> DataFrame:
    return _standard(spark, d).withColumn("test_date", F.col("test_date").cast("string")).withColumn("errors", F.array_join("errors", ","))


def ingest_run(spark: SparkSession, d: str) -> DataFrame:
    """Standardised, flagged against a history of every tenth order, scored."""
    rows = _standard(spark, d)
    history = ingest.flag_duplicates(rows.where("order_id % 10 = 0"), spark.createDataFrame([], "hash string"), list(_KEY))
    flagged = ingest.flag_duplicates(rows.where("order_id % 10 <> 0"), history, list(_KEY))
    done = ingest.score(flagged, F.lit(1.0), F.lit(False))
    return done.select(*_KEY, "hash", "is_duplicate", "category", F.col("confidence").cast("double").alias("confidence"), "is_usable")


def labs_updated(spark: SparkSession, d: str) -> DataFrame:
    """The dimension of laboratories with the results of a fraud pass; those without keep the default."""
    rel = fraud.lab_reliability(spark, d).select("lab_id", "reliability", "flagged", "reason")
    labs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name"))
    return labs.join(rel, "lab_id", "left").select("lab_id", "lab_name", F.coalesce("reliability", F.lit(0.7)).alias("reliability"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("reason", F.lit("")).alias("reason"))


def labs_by_name(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.concat(F.lit("SUPPLIER#00000"), F.lpad((F.col("c_custkey") % 50).cast("string"), 3, "0")).alias("name"))
    return ingest.labs_by_name(names, table(spark, d, "supplier").select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name")))


QUERIES = {f.__name__: f for f in (standardised_records, ingest_run, labs_updated, labs_by_name)}

_CANON = "case lower(trim(cname)) " + " ".join(f"when {_q(a)} then {_q(c)}" for a, c in L.CONTAMINANT_ALIASES.items()) + " end"
_LIMIT = "case contaminant " + " ".join(f"when {_q(c)} then {v}" for c, v in LIMITS.items()) + " end"
_STD = f"""s0 as (select *, [{', '.join(map(_q, NAMES))}][part_id % {len(NAMES)} + 1] as cname, try_cast(replace(value, ',', '') as double) * {_UNIT} as ppb,
  case when line <= 5 then day when line = 6 then left(day, 7) || '-01' end as test_date, line in (1, 3) and day(day::date) <= 12 and day(day::date) <> month(day::date) as date_ambiguous, case when state <> '' then {_STATE} end as st from raw),
s1 as (select *, {_CANON} as contaminant from s0), s2 as (select *, {_LIMIT}::double as limit_ppb from s1),
sr as (select {_K}, lower(food) as commodity, contaminant, case when contaminant is not null then 100.0 end::double as match_score, ppb, limit_ppb, coalesce({_PASS}, ppb <= limit_ppb) as pass_fail, test_date, date_ambiguous, st as state, '' as district, lab,
  concat_ws(',', case when cname <> '' and contaminant is null then 'contaminant' end, case when ppb is null then 'unit' end, case when test_date is null then 'date' end) as errors from s2)"""
_H = "sha256(concat_ws('|', coalesce(test_date, ''), lab, commodity, coalesce(contaminant, ''), coalesce(ppb, 0)::decimal(38,3)::varchar, ''))"
_RANGES = ", ".join(f"({_q(c)}, {_q(g)}, {lo!r}::double, {hi!r}::double)" for (c, g), (lo, hi) in L.TYPICAL_RANGES.items())

ORACLES = {
    "standardised_records": f"with {RAW}, {_STD} select * from sr",
    "ingest_run": f"""with {RAW}, {_STD}, h as (select *, {_H} as hash, {_CATEGORY('commodity')} as category from sr),
g as (select h.*, row_number() over (partition by hash order by {_K}) > 1 or hash in (select hash from h where order_id % 10 = 0) as is_duplicate from h where order_id % 10 <> 0),
c as (select g.*, (0.70 + case when {_TIER('lab')} = 1 then 0.10 else 0 end + case when coalesce(ppb between lo and hi, false) then 0.05 else 0 end)::decimal(5,3) as conf from g left join (values {_RANGES}) v(vc, vg, lo, hi) on vc = contaminant and vg = category)
select {_K}, hash, is_duplicate, category, conf::double as confidence, conf >= 0.75 as is_usable from c""",
    "labs_updated": f"with {ER}, {fraud._GROUPS}, {fraud._REL} select s_suppkey as lab_id, s_name as lab_name, coalesce(reliability, 0.7)::double as reliability, coalesce(flagged, false) as flagged, coalesce(reason, '') as reason from supplier left join rel on lab_id = s_suppkey",
    "labs_by_name": "with n as (select distinct 'SUPPLIER#00000' || lpad((c_custkey % 50)::varchar, 3, '0') as name from customer) select name, min(s_suppkey) as lab_id from n join supplier on contains(lower(s_name), lower(name)) group by name",
}
