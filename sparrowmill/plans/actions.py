"""What changes tables: disputes, a fraud pass with its write-back, estimates for brands, views of one user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S
from sparrowmill.operators import access, disputes, fraud_pass, graph
from sparrowmill.plans import chain, fraud
from sparrowmill.plans.views import AS_OF, ER, facts, unsuspected, usable
from sparrowmill.storage import table, written

# -- disputes: clicks submit, the error, purchase and view events after them review ----


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.substring_index("p_brand", "#", -1).cast("long").alias("brand_id"), F.col("p_brand").alias("brand_name")).distinct()


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "events").where("event_type = 'click'")
    return clicks.select(F.col("event_id").alias("dispute_id"), (F.col("user_id") % 30 + 1).alias("brand_id"), (F.col("event_id") % 1500).alias("record_id"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@x.com")).alias("email"), F.col("ts").cast("string").alias("at"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "resolved_removed").when(F.col("event_type") == "purchase", "resolved_kept").when(F.col("event_type") == "view", "unknown")
    rows = table(spark, d, "events").select((F.col("event_id") - 1 - F.col("event_id") % 2).alias("dispute_id"), F.col("event_id").alias("review_id"), outcome.alias("outcome"), F.col("ts").cast("string").alias("at"))
    return rows.where("outcome is not null")


def _disputes(spark: SparkSession, d: str) -> DataFrame:
    return disputes.states(_submissions(spark, d), _reviews(spark, d), _brands(spark, d))


def disputes_reviewed(spark: SparkSession, d: str) -> DataFrame:
    return _disputes(spark, d)


def disputes_pending(spark: SparkSession, d: str, status: str | None = "pending", limit: int = 100) -> DataFrame:
    """The administrator's list, oldest first; any status if it is None."""
    return disputes.listed(_disputes(spark, d), _brands(spark, d), status, limit=limit)


def disputes_of_brand(spark: SparkSession, d: str, brand_id: int = 7) -> DataFrame:
    """A brand's disputes, newest first."""
    return disputes.listed(_disputes(spark, d), _brands(spark, d), brand_id=brand_id, newest_first=True)


def brand_flags(spark: SparkSession, d: str) -> DataFrame:
    return disputes.brand_flags(_disputes(spark, d))


def disputed_records(spark: SparkSession, d: str) -> DataFrame:
    """Results (here all of an order are one record) after reviews; those removed have no confidence."""
    records = facts(spark, d, flags=False).withColumn("record_id", F.col("order_id"))
    out = disputes.without_confidence(records, _disputes(spark, d))
    return out.select("order_id", "contaminant_id", "part_id", "lab_id", "amount", F.col("confidence_score").cast("double").alias("confidence_score"), (F.col("confidence_score") >= L.USABLE).alias("usable"))


def dispute_audit(spark: SparkSession, d: str) -> DataFrame:
    return disputes.audit(_submissions(spark, d), _reviews(spark, d), _brands(spark, d))


# -- a fraud pass ------------------------------------------------------------------

_ID = list(fraud._ID)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Results as stored before the pass: parsed two days after the test, with old columns of the pass."""
    old = {"fraud_flags": F.lit(None).cast("array<struct<type:string,score:double>>"), "fraud_score": F.col("fraud_score").cast("double"), "geo_plausibility_ok": F.lit(None).cast("boolean"), "value_is_round": F.lit(None).cast("boolean"), "lab_flagged": F.lit(None).cast("boolean")}
    return facts(spark, d).withColumn("parsed_at", F.date_add("test_date", 2)).withColumns(old)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """What the pass finds for every result, stored, as passes over different days read it."""
    return written(fraud._scored(spark, d).select(*_ID, "flags", "bad_lab"), "scored")


def _passed(spark: SparkSession, d: str, days: int, scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All results, and those of the last days with what the pass found."""
    stored = _stored(spark, d)
    scored = fraud._scored(spark, d) if scored is None else scored
    chosen = fraud_pass.selected(stored, "order_id", None, AS_OF, days)
    found = scored.select(*_ID, "flags", "bad_lab").join(chosen.select(*_ID, "ppb"), _ID)
    score = F.aggregate("flags", F.lit(0).cast("decimal(6,2)"), lambda acc, f: (acc + f["score"].cast("decimal(4,2)")).cast("decimal(6,2)"))
    new = found.select(*_ID, F.col("flags").alias("fraud_flags"), F.least(score, F.lit(1).cast("decimal(6,2)")).cast("double").alias("fraud_score"), F.lit(True).alias("geo_plausibility_ok"), S.is_round(F.col("ppb") / 4).alias("value_is_round"), F.coalesce("bad_lab", F.lit(False)).alias("lab_flagged"))
    return stored, new


def fraud_pass_written(spark: SparkSession, d: str, days: int = 7) -> DataFrame:
    """Every result after the pass: those of the last days rewritten, the others as they were."""
    out = fraud_pass.write_back(*_passed(spark, d, days), _ID)
    return out.select(*_ID, F.size(F.coalesce("fraud_flags", F.expr("cast(array() as array<struct<type:string,score:double>>)"))).alias("n_flags"), "fraud_score", "geo_plausibility_ok", "value_is_round", "lab_flagged")


def fraud_pass_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Results of given orders that a pass over them would score."""
    ids = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("order_id"))
    return fraud_pass.selected(_stored(spark, d), "order_id", ids, AS_OF).select(*_ID, "is_duplicate")


def fraud_audit_appended(spark: SparkSession, d: str, days: int = 60) -> DataFrame:
    """The audit after passes over the last days and, twice, over all twice as many."""
    key = _ID
    none = spark.createDataFrame([], "order_id long, contaminant_id int, part_id long, lab_id long, amount double, flag_type string, score double")
    scored = _scored(spark, d)
    first, all_ = _passed(spark, d, days, scored)[1], _passed(spark, d, 2 * days, scored)[1]
    once = fraud_pass.append_audit(none, first, key)
    return fraud_pass.append_audit(fraud_pass.append_audit(once, all_, key), all_, key)


def fraud_records_named(spark: SparkSession, d: str, least: float = 0.20, limit: int = 100) -> DataFrame:
    """The most suspicious results with the names of their laboratory and place."""
    scored = fraud.record_fraud_scores(spark, d).where(F.col("fraud_score") >= least)
    places = facts(spark, d).where(~F.col("is_duplicate")).select(*_ID, "district", "state", "commodity")
    labs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name"))
    return scored.orderBy(F.desc("fraud_score"), *_ID).limit(limit).join(places, _ID).join(labs, "lab_id", "left").select(*_ID, "fraud_score", "flags", "district", "state", "commodity", "lab_name")


# -- brands, users -----------------------------------------------------------------


def brand_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of brands in the supply chain with what they rest on, and their profile where they have one."""
    estimates = graph.brand_estimates(chain.graph_propagation(spark, d)).where("node > 10000000")
    brands = _brands(spark, d).select((F.col("brand_id") + 10000000).alias("node"), "brand_name")
    profile = facts(spark, d).where(usable() & unsuspected() & F.col("brand").isNotNull()).groupBy(F.col("brand").alias("brand_name")).agg(F.count(F.lit(1)).alias("n_tests"))
    return brands.join(estimates, "node").join(profile, "brand_name", "left").select("node", "brand_name", "estimate", "confidence", "inference_type", "label", "n_tests")


def upstream_edges(spark: SparkSession, d: str, node: int = 10000011) -> DataFrame:
    edges = written(chain.edges(spark, d), "edges")
    return graph.upstream(edges, node)


def own_rows(spark: SparkSession, d: str, user: int | None = 42) -> DataFrame:
    """What a user may see of a table with row-level security: their own rows; without user, none."""
    return access.visible(table(spark, d, "orders"), "o_custkey", user).select("o_orderkey", "o_custkey", "o_orderstatus")


QUERIES = {
    f.__name__: f
    for f in (
        disputes_reviewed, disputes_pending, disputes_of_brand, brand_flags, disputed_records, dispute_audit, fraud_pass_written, fraud_pass_by_id, fraud_audit_appended, fraud_records_named, brand_estimates,
        upstream_edges, own_rows,
    )
}

_DISPUTES = """br as (select distinct split_part(p_brand, '#', 2)::bigint as brand_id, p_brand as brand_name from part),
sb as (select event_id as dispute_id, user_id % 30 + 1 as brand_id, event_id % 1500 as record_id, user_id, ts as sent from events where event_type = 'click'),
rv as (select event_id - 1 - event_id % 2 as dispute_id, event_id as review_id, case event_type when 'error' then 'resolved_removed' else 'resolved_kept' end as outcome, ts as told from events where event_type in ('error', 'purchase')),
last as (select * from rv qualify row_number() over (partition by dispute_id order by told desc, review_id desc) = 1),
ds as (select dispute_id, brand_id, record_id, 'user' || user_id || '@x.com' as email, sent, coalesce(outcome, 'pending') as status, told from sb left join last using (dispute_id) where brand_id in (select brand_id from br))"""
_AT = lambda c: f"regexp_replace({c}::varchar, '\\.?0+$', '')"
_LISTED = f"""select dispute_id, brand_id, record_id, 'us***@x.com' as email, {_AT('sent')} as "at", status, {_AT('told')} as resolved_at, brand_name from ds join br using (brand_id)"""
_IDS = "order_id, contaminant_id, part_id, lab_id, amount"
_F = f"{ER}, {fraud._GROUPS}, {fraud._REL}, {fraud._CLUSTER}, {fraud._FLAGS}, {fraud._SCORES}"
_LAST = lambda days: f"test_date + 2 >= date '{AS_OF}' - {days}"
_AUDIT = lambda name, score, days: f"select {_IDS}, '{name}' as flag_type, {score}::double as score from fl join er using ({_IDS}) where not is_duplicate and {_LAST(days)}"

ORACLES = {
    "disputes_reviewed": f"""with {_DISPUTES} select dispute_id, brand_id, record_id, email, {_AT('sent')} as "at", status, {_AT('told')} as resolved_at from ds""",
    "disputes_pending": f"with {_DISPUTES}, x as (select * from ds where status = 'pending' order by sent, dispute_id limit 100) {_LISTED.replace('from ds', 'from x')}",
    "disputes_of_brand": f"with {_DISPUTES} {_LISTED} where brand_id = 7",
    "brand_flags": f"with {_DISPUTES} select brand_id, count(*) as dispute_count, count(*) filter (status = 'pending') as n_open, count(*) filter (status = 'pending') > 0 as under_dispute from ds group by brand_id",
    "disputed_records": f"with {ER}, {_DISPUTES}, x as (select *, case when order_id in (select record_id from ds where status = 'resolved_removed') then 0 else confidence_score end as c from er) select {_IDS}, c::double as confidence_score, c >= {L.USABLE} as usable from x",
    "dispute_audit": f"""with {_DISPUTES} select {_AT('sent')} as "at", 'dispute_submitted' as action, dispute_id, '{{"dispute_id":' || dispute_id || ',"brand_id":' || brand_id || '}}' as metadata from ds
union all select {_AT('told')}, 'dispute_reviewed', dispute_id, '{{"dispute_id":' || dispute_id || ',"outcome":"' || outcome || '"}}' from rv where dispute_id in (select dispute_id from ds)""",
    "fraud_pass_written": f"""with {_F}, y as (select er.*, {_LAST(7)} and not is_duplicate as hit from er)
select {_IDS}, case when hit then (a::int + b::int + c::int) else 0 end as n_flags, case when hit then sc.fraud_score else y.fraud_score::double end as fraud_score, case when hit then true end as geo_plausibility_ok, case when hit then a end as value_is_round,
case when hit then b end as lab_flagged from y left join fl using ({_IDS}) left join sc using ({_IDS})""",
    "fraud_pass_by_id": f"with {ER} select {_IDS}, is_duplicate from er where order_id % 50 = 0",
    "fraud_audit_appended": f"with {_F} {_AUDIT('round_value', 0.10, 120)} and a union all {_AUDIT('lab', 0.25, 120)} and b union all {_AUDIT('cluster', 0.20, 120)} and c",
    "fraud_records_named": f"with {_F}, t as (select * from sc where fraud_score >= 0.20 order by fraud_score desc, {_IDS} limit 100) select {_IDS}, t.fraud_score, flags, district, state, commodity, s_name as lab_name from t join er using ({_IDS}) left join supplier on lab_id = s_suppkey where not is_duplicate",
    "brand_estimates": f"""with {ER}, {chain._NODES}, {chain._EDGES}, {chain._LEVEL}, {', '.join(chain._step(k) for k in range(4))}, pr as (select brand as brand_name, count(*) as n_tests from ok where brand is not null and (fraud_score is null or fraud_score < {L.SUSPECT}) group by all)
select node, 'Brand#' || (node - 10000000) as brand_name, round(estimate, 9) as estimate, round(confidence, 9)::double as confidence, case source when 'measured' then 'direct_test' when 'propagated' then 'propagated' else 'insufficient_data' end as inference_type,
case source when 'measured' then 'Tested: based on direct enforcement records' else 'Inferred from supply chain data, no direct test on this product' end as label, n_tests
from ({' union all '.join(f'select * from p{k}' for k in range(4))}) e left join pr on pr.brand_name = 'Brand#' || (node - 10000000) where node > 10000000""",
    "upstream_edges": f"""with recursive {chain._EDGES}, an as (select 10000011::bigint as node union select source from an join e on target = node)
select source, target, case when (source + target) % 5 > 0 then 1 - ((source + target) % 5) / 10 end as retention, case when (source * 3 + target) % 4 > 0 then ((source * 3 + target) % 4) / 4 end as link from e0 where source in (from an) and target in (from an)""",
    "own_rows": "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey = 42",
}
