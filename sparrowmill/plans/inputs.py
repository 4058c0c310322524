"""Sources, streams and the risk forest over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.operators import forest
from sparrowmill.plans import risk
from sparrowmill.plans.standard import RAW, raw
from sparrowmill.sources import formats
from sparrowmill.storage import table, written
from sparrowmill.streaming import ingest


def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """The pages here link to no reports, so every address counts."""
    return formats.html_links(table(spark, d, "pages"), "").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.min("title").alias("first_title"))


def rss_items(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    item = F.concat(F.lit("<item><title>Import Alert - "), F.col("p_type"), F.lit(" - Lead - India</title><pubDate>"), F.col("p_size").cast("string"), F.lit("</pubDate></item>"))
    feeds = part.select(F.concat(F.lit("feed:"), F.col("p_partkey").cast("string")).alias("feed_url"), F.concat(F.lit("<rss><channel>"), item, item, F.lit("</channel></rss>")).alias("xml"))
    return formats.feed_items(feeds)


def market_json(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    one = F.concat(F.lit('{"Commodity": "'), F.col("c_mktsegment"), F.lit('", "date": "2024-01-01", "min_price": 0, "modal_price": '), F.col("c_custkey").cast("string"), F.lit("}"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"records": ['), one, F.lit("]}")))
    return formats.market_records(c.select(F.col("c_custkey").cast("string").alias("source_url"), text.alias("json")))


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    t = F.array(
        F.array(F.lit("Food Article"), F.lit("Test Parameter"), F.lit(" Value found "), F.lit("Unit"), F.lit("Status")),
        F.array(F.col("food"), F.lit("Lead"), F.col("value"), F.col("unit"), F.col("verdict")),
        F.array(F.lit(""), F.lit(None).cast("string"), F.lit(" "), F.lit(""), F.lit("")),
    )
    keyed = raw(spark, d).select(F.concat_ws("-", "order_id", "part_id", "lab_id", "line", "day").alias("source_url"), t.alias("rows"))
    return formats.table_records(keyed).select("source_url", "row_no", "product_name", "contaminant", "value", "unit", "pass_fail", "brand")


def regex_fields(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Sample of "), F.col("food"), F.lit(" had Lead at "), F.col("quantity").cast("int").cast("string"), F.lit(" mg/kg on "), F.col("date"), F.lit(" in Kerala; "), F.col("verdict"), F.lit(" LAB/AB1234"))
    rows = raw(spark, d).select("order_id", "part_id", "lab_id", "line", "day", text.alias("text"))
    found = formats.text_fields(rows.withColumnRenamed("lab_id", "lab"), "text")
    return found.select("order_id", "part_id", "lab", "line", "day", "contaminant", "value", "unit", "verdict", "state", F.col("lab_id").alias("lab_code"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.event_windows(spark, d)


def rf_scores(spark: SparkSession, d: str, trees: int = 300) -> DataFrame:
    """Scores of all rows by a forest that hasn't seen two of the regions."""
    rows = written(risk.risk_features(spark, d), "features")
    states = [r[0] for r in table(spark, d, "region").select("r_name").orderBy("r_name").limit(2).collect()]
    model, _ = forest.fit(rows, tuple(states), trees=trees)
    return forest.scores(model, rows).select("district_id", "commodity", "quarter", "risk", "lower", "upper")


QUERIES = {f.__name__: f for f in (json_props, html_links, rss_items, market_json, table_rows, regex_fields, stream_windows, rf_scores)}

ORACLES = {
    "json_props": "select event_id, regexp_extract(props, '\"k\": (-?[0-9]+)', 1)::int as k from events",
    "html_links": """with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) as inner_ from pages),
t as (select page_id, href, coalesce(nullif(trim(regexp_replace(inner_, '<[^>]*>', '', 'g')), ''), regexp_extract(href, '([^/]*?)(?:\\.[^./]*)?$', 1)) as title from a)
select page_id, count(distinct href) as n_links, min(title) as first_title from t group by page_id""",
    "rss_items": "select 'feed:' || p_partkey as link, p_type as product, 'Lead' as contaminant, p_size::varchar as date, 'fail' as pass_fail from part, range(2)",
    "market_json": "select c_custkey::varchar as source_url, c_mktsegment as product, '2024-01-01' as date, null::varchar as state, null::varchar as district, nullif(c_custkey::varchar, '0') as value from customer",
    "table_rows": f"with {RAW} select concat_ws('-', order_id, part_id, lab_id, line, day) as source_url, 0 as row_no, food as product_name, 'Lead' as contaminant, value, unit, nullif(verdict, '') as pass_fail, null::varchar as brand from raw",
    "regex_fields": f"""with {RAW} select order_id, part_id, lab_id as lab, line, day, 'Lead' as contaminant, quantity::int::varchar as value, 'mg/kg' as unit,
case when line <= 5 then verdict end as verdict, 'Kerala' as state, 'LAB/AB1234' as lab_code from raw""",
    "stream_windows": "select ts::date::varchar as day, event_type, count(*) as n, sum(value::decimal(18,2))::double as total from events group by all",
}
