"""Risk reports: quarterly aggregates, event lists, maps, gaps, profiles, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S
from sparrowmill.operators import features
from sparrowmill.plans.views import AGG, COMMODITIES, ER, facts, months_ago, quarters, since, usable
from sparrowmill.storage import table

DISTRICT, COMMODITY, BRAND = 1, "PROMO", "Brand#11"


def agg_district_quarter(spark: SparkSession, d: str) -> DataFrame:
    return quarters(facts(spark, d))


def latest_aggregate(spark: SparkSession, d: str, district: int = DISTRICT, commodity: str = COMMODITY) -> DataFrame:
    own = facts(spark, d).where((F.col("district_id") == district) & (F.col("commodity") == commodity))
    return quarters(own).orderBy(F.desc("quarter")).limit(1)


def _event() -> list:
    return ["order_id", "contaminant_id", "part_id", "lab_id", F.col("test_date").cast("string").alias("test_date"), "ppb", "pass_fail", F.col("confidence_score").cast("double").alias("confidence_score")]


def _latest() -> list:
    """Newest first, then by key."""
    return [F.col("test_date").desc_nulls_last(), "order_id", "contaminant_id", "part_id", "lab_id"]


def district_events_topk(spark: SparkSession, d: str, district: int = DISTRICT, commodity: str = COMMODITY, limit: int = 50) -> DataFrame:
    own = facts(spark, d).where(usable() & since(24) & (F.col("district_id") == district) & (F.col("commodity") == commodity))
    labs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name"))
    return own.join(labs, "lab_id", "left").orderBy(*_latest()).limit(limit).select(*_event(), "lab_name")


def brand_events_topk(spark: SparkSession, d: str, brand: str = BRAND, limit: int = 30) -> DataFrame:
    own = facts(spark, d).where(usable() & (F.col("brand") == brand))
    labs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name"))
    return own.join(labs, "lab_id", "left").orderBy(*_latest()).limit(limit).select(*_event(), "lab_name", "district")


def alerts_topk(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    failed = facts(spark, d).where(usable() & (F.col("pass_fail") == F.lit(False)))
    return failed.orderBy(*_latest()).limit(limit).select(*_event(), "district", "commodity", "brand")


def heatmap_latest(spark: SparkSession, d: str, commodity: str = COMMODITY) -> DataFrame:
    """The latest quarter of each district."""
    own = quarters(facts(spark, d).where(F.col("commodity") == commodity))
    newest = Window.partitionBy("district_id").orderBy(F.desc("quarter"))
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district"))
    return own.withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r").join(places, "district_id")


def market_gaps(spark: SparkSession, d: str, state: str | None = None, below: float = 30.0, least: int = 5, limit: int = 20) -> DataFrame:
    """Safe, well-tested pairs of district and commodity with the fewest brands."""
    er = facts(spark, d)
    er = er if state is None else er.where(F.col("state") == state)
    safe = quarters(er).where((F.col("risk_score") < below) & (F.col("n_tests") >= least))
    brands = er.groupBy("district_id", "commodity").agg(F.countDistinct("brand").alias("brand_count"))
    counted = safe.join(brands, ["district_id", "commodity"], "left").select("district_id", "commodity", "quarter", "risk_score", "n_tests", F.coalesce("brand_count", F.lit(0)).alias("brand_count"))
    return counted.orderBy("brand_count", "risk_score", "district_id", "commodity", "quarter").limit(limit)


def insurance_profile(spark: SparkSession, d: str, districts: str = "1, 2, x, 7", limit: int = 100) -> DataFrame:
    """districts: numbers with commas between them; what is no number is passed over."""
    ids = [int(x) for x in districts.split(",") if x.strip().isdigit()]
    er = facts(spark, d).where(F.col("district_id").isin(ids))
    pairs = er.select("district_id", "commodity", "contaminant_id").distinct()
    joined = quarters(er).join(pairs, ["district_id", "commodity"])
    return joined.select("district_id", "commodity", "contaminant_id", "quarter", "risk_score", "n_tests").orderBy(F.desc("risk_score"), "district_id", "commodity", "contaminant_id", "quarter").limit(limit)


def search_union(spark: SparkSession, d: str, q: str = "r", district: int | None = None, limit: int = 10) -> DataFrame:
    """Commodities with their risk, and brands, whose name or alias contains q in either case."""
    er = facts(spark, d)
    risk = quarters(er if district is None else er.where(F.col("district_id") == district))
    names = spark.createDataFrame([(i, c, [c.lower(), c[:3].lower()]) for i, c in enumerate(COMMODITIES)], "id int, name string, aliases array<string>")
    like = f"%{q}%"
    hits = names.where(F.col("name").ilike(like) | F.exists("aliases", lambda a: a.ilike(like)))
    goods = hits.join(risk, F.col("name") == F.col("commodity"), "left").orderBy("id", "district_id", "quarter").limit(limit)
    goods = goods.select(F.lit("commodity").alias("type"), "name", F.col("district_id").cast("string").alias("district_id"), "quarter", "risk_score")
    brands = table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct().where(F.col("name").ilike(like)).orderBy("name").limit(limit)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("district_id", "string"), ("quarter", "string"), ("risk_score", "double"))]
    return goods.unionByName(brands.select(F.lit("brand").alias("type"), "name", *none))


def brand_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per brand and commodity: tests, failures, mean value, and whether that is enough for a direct judgement."""
    grouped = facts(spark, d).where(usable() & F.col("brand").isNotNull()).groupBy("brand", "commodity")
    counted = grouped.agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("pass_fail") == F.lit(False)).alias("n_failures"), (F.sum(F.col("ppb").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("avg_ppb"))
    return counted.withColumn("inference", F.when(F.col("n_tests") >= 3, "direct_test").otherwise("insufficient_data"))


def risk_features(spark: SparkSession, d: str) -> DataFrame:
    """Training features: change since the quarter before, the state's mean, season, label."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("district_id"), F.col("r_name").alias("state"))
    base = quarters(facts(spark, d)).where("n_tests >= 3").join(places, "district_id")
    before = F.lag("fail_rate").over(Window.partitionBy("district_id", "commodity").orderBy("quarter"))
    exact = F.col("fail_rate").cast("decimal(10,4)")
    peers = Window.partitionBy("state", "commodity", "quarter")
    mean = F.sum(exact).over(peers).cast("double") / F.count(F.lit(1)).over(peers)
    slope = F.coalesce(exact - before.cast("decimal(10,4)"), F.lit(0).cast("decimal(10,4)")).cast("double")
    return base.select(
        "district_id", "commodity", "quarter", "state", "n_tests", "fail_rate", slope.alias("slope"), mean.alias("state_rate"), S.quarter_season(F.col("quarter")).alias("season"),
        F.lit(50.0).alias("wqi"), F.lit(500.0).alias("density"), (F.col("fail_rate") > 0).cast("int").alias("label"),
    )


def _measured_districts(spark: SparkSession, d: str) -> DataFrame:
    """Districts with water (here the largest balance of their customers) and industry (their suppliers), each unknown in some."""
    t = lambda name: table(spark, d, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("district_id"), F.col("r_name").alias("state"))
    water = t("customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("district_id")).agg((F.max("c_acctbal") / 100).alias("wqi"))
    industry = t("supplier").where("s_nationkey % 4 > 0").groupBy(F.col("s_nationkey").alias("district_id")).agg(F.count(F.lit(1)).cast("double").alias("industry"))
    return places.join(water, "district_id", "left").join(industry, "district_id", "left")


def features_imputed(spark: SparkSession, d: str) -> DataFrame:
    """Training features with stand-ins for what isn't known of a district; nothing is known of densities."""
    return features.training_features(quarters(facts(spark, d)), _measured_districts(spark, d))


QUERIES = {f.__name__: f for f in (agg_district_quarter, latest_aggregate, district_events_topk, brand_events_topk, alerts_topk, heatmap_latest, market_gaps, insurance_profile, search_union, brand_profile, risk_features, features_imputed)}

_EV = "order_id, contaminant_id, part_id, lab_id, test_date::varchar as test_date, ppb, pass_fail, confidence_score::double as confidence_score"
_BY = "test_date desc, order_id, contaminant_id, part_id, lab_id"
_NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(COMMODITIES))

ORACLES = {
    "agg_district_quarter": f"with {ER}, {AGG} select * from agg",
    "latest_aggregate": f"with {ER}, {AGG} select * from agg where district_id = {DISTRICT} and commodity = '{COMMODITY}' order by quarter desc limit 1",
    "district_events_topk": f"""with {ER}, x as (select * from ok where test_date >= {months_ago(24)} and district_id = {DISTRICT} and commodity = '{COMMODITY}' order by {_BY} limit 50)
select {_EV}, s_name as lab_name from x left join supplier on lab_id = s_suppkey""",
    "brand_events_topk": f"with {ER}, x as (select * from ok where brand = '{BRAND}' order by {_BY} limit 30) select {_EV}, s_name as lab_name, district from x left join supplier on lab_id = s_suppkey",
    "alerts_topk": f"with {ER}, x as (select * from ok where pass_fail = false order by {_BY} limit 20) select {_EV}, district, commodity, brand from x",
    "heatmap_latest": f"""with {ER}, {AGG} select agg.*, n_name as district from (select *, row_number() over (partition by district_id order by quarter desc) as r from agg where commodity = '{COMMODITY}') t
join agg using (district_id, commodity, quarter) join nation on district_id = n_nationkey where r = 1""",
    "market_gaps": f"""with {ER}, {AGG} select a.district_id, a.commodity, a.quarter, a.risk_score, a.n_tests, count(distinct e.brand) as brand_count
from agg a left join er e on e.district_id = a.district_id and e.commodity = a.commodity and e.brand is not null
where a.risk_score < 30 and a.n_tests >= 5 group by all order by brand_count, risk_score, district_id, commodity, quarter limit 20""",
    "insurance_profile": f"""with {ER}, {AGG} select distinct a.district_id, a.commodity, e.contaminant_id, a.quarter, a.risk_score, a.n_tests
from agg a join er e on e.district_id = a.district_id and e.commodity = a.commodity where a.district_id in (1, 2, 7)
order by risk_score desc, district_id, commodity, contaminant_id, quarter limit 100""",
    "search_union": f"""with {ER}, {AGG}, c as (select * from (values {_NAMES}) t(id, name) where name ilike '%r%' or lower(name) ilike '%r%')
(select 'commodity' as type, name, district_id::varchar as district_id, quarter, risk_score from c left join agg on commodity = name order by id, district_id, quarter limit 10)
union all (select 'brand', p_brand, null, null, null from (select distinct p_brand from part where p_brand ilike '%r%') order by p_brand limit 10)""",
    "brand_profile": f"""with {ER} select brand, commodity, count(*) as n_tests, count(*) filter (pass_fail = false) as n_failures, sum(ppb::decimal(18,2))::double / count(*) as avg_ppb,
case when count(*) >= 3 then 'direct_test' else 'insufficient_data' end as inference from ok where brand is not null group by brand, commodity""",
    "risk_features": f"""with {ER}, {AGG}, b as (select agg.*, r_name as state from agg join nation on district_id = n_nationkey join region on n_regionkey = r_regionkey where n_tests >= 3)
select district_id, commodity, quarter, state, n_tests, fail_rate,
coalesce(fail_rate::decimal(10,4) - lag(fail_rate) over (partition by district_id, commodity order by quarter)::decimal(10,4), 0)::double as slope,
sum(fail_rate::decimal(10,4)) over (partition by state, commodity, quarter)::double / count(*) over (partition by state, commodity, quarter) as state_rate,
right(quarter, 1)::int as season, 50.0::double as wqi, 500.0::double as density, (fail_rate > 0)::int as label from b""",
    "features_imputed": f"""with {ER}, {AGG}, w as (select c_nationkey as district_id, max(c_acctbal) / 100 as wqi from customer where c_nationkey % 3 > 0 group by all),
i as (select s_nationkey as district_id, count(*)::double as industry from supplier where s_nationkey % 4 > 0 group by all),
b as (select agg.*, r_name as state from agg join nation on district_id = n_nationkey join region on n_regionkey = r_regionkey where n_tests >= 3)
select district_id, commodity, quarter, state, n_tests, fail_rate,
coalesce(fail_rate::decimal(10,4) - lag(fail_rate) over (partition by district_id, commodity order by quarter)::decimal(10,4), 0)::double as slope,
coalesce(sum(fail_rate::decimal(10,4)) over (partition by state, commodity, quarter)::double / count(fail_rate) over (partition by state, commodity, quarter), fail_rate) as state_rate,
right(quarter, 1)::int as season, coalesce(wqi, 50) as wqi, coalesce(industry, 50) as industry, 500.0::double as density, (coalesce(fail_rate, 0) > 0)::int as label
from b left join w using (district_id) left join i using (district_id)""",
}
