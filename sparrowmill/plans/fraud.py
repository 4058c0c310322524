"""Signs of invented results: first digits, round and repeated values, pass rates out of line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S
from sparrowmill.plans.views import ER, facts, months_ago, since, usable
from sparrowmill.storage import table

WINDOW_MONTHS, LEAST_TESTS = 24, 5


def _with_digit(er: DataFrame) -> DataFrame:
    """The first digit as a column of its own, so that nine counts find it once."""
    return er.withColumn("digit", S.first_digit(F.col("amount")))


def _digits() -> list[Column]:
    return [F.count_if(F.col("digit") == k).alias(f"d{k}") for k in range(1, 10)]


def _chi2(n: Column) -> Column:
    """Of the columns d1 to d9 against n times the expected shares; 0 for fewer than BENFORD_LEAST digits."""
    total = sum(((F.col(f"d{k}") - n * share) * (F.col(f"d{k}") - n * share) / (n * share) for k, share in L.BENFORD.items()), F.lit(0.0))
    return F.when(n >= L.BENFORD_LEAST, total).otherwise(F.lit(0.0))


def _n_digits() -> Column:
    return sum((F.col(f"d{k}") for k in range(2, 10)), F.col("d1"))


def benford_digits(spark: SparkSession, d: str) -> DataFrame:
    return _with_digit(facts(spark, d).where(usable())).groupBy("lab_id", "commodity").agg(*_digits())


def benford_chi2(spark: SparkSession, d: str) -> DataFrame:
    counted = benford_digits(spark, d).withColumn("n", _n_digits()).withColumn("x", _chi2(F.col("n")))
    p = F.when(F.col("n") >= L.BENFORD_LEAST, S.chi2_survival_8(F.col("x"))).otherwise(F.lit(1.0))
    return counted.select("lab_id", "commodity", "n", F.round("x", 6).alias("chi2"), F.round(p, 6).alias("p"), (p < L.BENFORD_P).alias("suspicious"))


def round_fraction(spark: SparkSession, d: str) -> DataFrame:
    grouped = facts(spark, d).where(usable()).groupBy("lab_id")
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(S.is_round(F.col("amount"))).alias("n_round"))
    return counted.withColumn("fraction", F.col("n_round") / F.col("n"))


def _lab_groups(er: DataFrame) -> DataFrame:
    passed = F.coalesce(F.col("pass_fail"), F.lit(False))
    recent = er.where(usable() & since(WINDOW_MONTHS))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("n_pass"), F.count_if(S.is_round(F.col("amount"))).alias("n_round"), *_digits()]
    return _with_digit(recent).groupBy("lab_id", "commodity", "state").agg(*aggs)


def lab_state_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Each laboratory's pass rate against the mean and deviation of its state and commodity.

    State figures come from the laboratories' partial counts: of a 0/1 variable n
    and its sum give mean and sample variance, so the facts are read once.
    """
    return _zscores(_lab_groups(facts(spark, d))).select("lab_id", "commodity", "state", "n", "pass_rate", "mean", F.round("z", 9).alias("z"))


def _zscores(groups: DataFrame) -> DataFrame:
    state = groups.groupBy("state", "commodity").agg(F.sum("n").alias("sn"), F.sum("n_pass").alias("sp"))
    p = F.col("sp") / F.col("sn")
    deviation = F.when(F.col("sn") > 1, F.sqrt(F.col("sn") * p * (1 - p) / (F.col("sn") - 1)))
    state = state.select(F.col("state").alias("s"), F.col("commodity").alias("c"), p.alias("mean"), deviation.alias("deviation"))
    joined = groups.where(F.col("n") >= LEAST_TESTS).join(state, F.col("state").eqNullSafe(F.col("s")) & (F.col("commodity") == F.col("c"))).drop("s", "c")
    rate = F.col("n_pass") / F.col("n")
    floor = F.greatest(F.coalesce(F.col("deviation"), F.lit(0.0)), F.lit(0.01))
    return joined.withColumn("pass_rate", rate).withColumn("z", (rate - F.col("mean")) / floor)


def lab_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Per laboratory its worst group: reliability, signs and figures of that group."""
    g = _zscores(_lab_groups(facts(spark, d))).withColumn("nd", _n_digits()).withColumn("x", _chi2(F.col("nd")))
    outlier = F.round("z", 9) > L.LAB_Z
    benford = (F.col("nd") >= L.BENFORD_LEAST) & (S.chi2_survival_8(F.col("x")) < L.BENFORD_P)
    round_ = F.col("n_round") / F.col("n") > L.ROUND_SHARE
    loss = lambda sign, amount: F.when(sign, F.lit(amount)).otherwise(F.lit(0.0)).cast("decimal(4,2)")
    score = F.lit(L.LAB_BASE).cast("decimal(4,2)") - loss(outlier, L.LAB_OUTLIER) - loss(benford, L.LAB_BENFORD) - loss(round_, L.LAB_ROUND)
    score = F.greatest(F.lit(0.1).cast("decimal(4,2)"), F.least(F.lit(1).cast("decimal(4,2)"), score.cast("decimal(4,2)")))
    reason = F.concat_ws("; ", F.when(outlier, F.lit("pass rate outlier")), F.when(benford, F.lit("first digits")), F.when(round_, F.lit("round values")))
    g = g.withColumn("reliability", score.cast("double")).withColumn("reason", reason)
    worst = g.groupBy("lab_id").agg(F.min(F.struct("reliability", "commodity", "state", "pass_rate", "mean", "z", "reason", "n")).alias("w"))
    return worst.select("lab_id", "w.reliability", "w.commodity", "w.state", "w.n", F.round("w.pass_rate", 4).alias("pass_rate"), F.round("w.z", 3).alias("z"), "w.reason", (F.col("w.reason") != "").alias("flagged"))


def labs_ranked(spark: SparkSession, d: str, limit: int = 50) -> DataFrame:
    rel = lab_reliability(spark, d)
    labs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name"), (F.col("s_suppkey") % 3 + 1).alias("tier"))
    return labs.join(rel.select("lab_id", "reliability", "reason"), "lab_id", "left").orderBy(F.asc_nulls_last("reliability"), "lab_id").limit(limit)


def lab_commodity_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per laboratory, commodity and quarter: tests, passes, round values, first-digit statistic."""
    grouped = facts(spark, d).where(usable()).groupBy("lab_id", "commodity", S.quarter_label(F.col("test_date")).alias("quarter"))
    passed = F.coalesce(F.col("pass_fail"), F.lit(False))
    g = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("n_pass"), F.count_if(S.is_round(F.col("amount"))).alias("n_round"))
    return g


def _clusters(er: DataFrame) -> DataFrame:
    values = er.where(~F.col("is_duplicate") & since(12)).groupBy("lab_id", "commodity", "ppb").agg(F.count(F.lit(1)).alias("k"))
    top = values.groupBy("lab_id", "commodity").agg(F.sum("k").alias("n"), F.max(F.struct("k", (-F.col("ppb")).alias("v"))).alias("top"))
    share = F.col("top.k") / F.col("n")
    return top.select("lab_id", "commodity", "n", (-F.col("top.v")).alias("top_ppb"), share.alias("share"), ((F.col("n") >= L.CLUSTER_LEAST) & (share > L.CLUSTER_SHARE)).alias("clustered"))


def value_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(facts(spark, d))


_ID = ("order_id", "contaminant_id", "part_id", "lab_id", "amount")


def _scored(spark: SparkSession, d: str, cluster_share: float = 0.05) -> DataFrame:
    """Every result with its flags; the share for clusters is a parameter, as these data repeat few values."""
    er = facts(spark, d)
    labs = lab_reliability(spark, d).where("flagged").select("lab_id", F.lit(True).alias("bad_lab"))
    clusters = _clusters(er).where((F.col("n") >= L.CLUSTER_LEAST) & (F.col("share") > cluster_share)).select("lab_id", "commodity", F.col("top_ppb").alias("ppb"), F.lit(True).alias("in_cluster"))
    rows = er.where(~F.col("is_duplicate")).join(labs, "lab_id", "left").join(clusters, ["lab_id", "commodity", "ppb"], "left")
    flag = lambda sign, name, score: F.when(sign, F.struct(F.lit(name).alias("type"), F.lit(score).alias("score")))
    flags = F.array_compact(F.array(flag(S.is_round(F.col("ppb") / 4), "round_value", L.RECORD_ROUND), flag(F.col("bad_lab"), "lab", L.RECORD_LAB), flag(F.col("in_cluster"), "cluster", L.RECORD_CLUSTER)))
    return rows.withColumn("flags", flags)


def record_fraud_scores(spark: SparkSession, d: str) -> DataFrame:
    score = F.aggregate("flags", F.lit(0).cast("decimal(6,2)"), lambda acc, f: (acc + f["score"].cast("decimal(4,2)")).cast("decimal(6,2)"))
    return _scored(spark, d).select(*_ID, F.least(score, F.lit(1).cast("decimal(6,2)")).cast("double").alias("fraud_score"), F.array_join(F.transform("flags", lambda f: f["type"]), ",").alias("flags"))


def fraud_audit_explode(spark: SparkSession, d: str) -> DataFrame:
    """One row for each result and flag."""
    return _scored(spark, d).select(*_ID, F.explode("flags").alias("f")).select(*_ID, F.col("f.type").alias("flag_type"), F.col("f.score").alias("score"))


def fraud_records_topk(spark: SparkSession, d: str, least: float = 0.20, limit: int = 100) -> DataFrame:
    return record_fraud_scores(spark, d).where(F.col("fraud_score") >= least).orderBy(F.desc("fraud_score"), *_ID).limit(limit)


def geo_node_counts(spark: SparkSession, d: str) -> DataFrame:
    """Supply-chain nodes in each result's district; counted once, then joined."""
    nodes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("district_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
    er = facts(spark, d, flags=False).groupBy("district_id", "commodity").agg(F.count(F.lit(1)).alias("n_tests"))
    return er.join(nodes, "district_id", "left").select("district_id", "commodity", "n_tests", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


QUERIES = {
    f.__name__: f
    for f in (
        benford_digits, benford_chi2, round_fraction, lab_state_zscore, lab_reliability, labs_ranked, lab_commodity_stats, value_clusters, record_fraud_scores, fraud_audit_explode, fraud_records_topk, geo_node_counts,
    )
}

_DIGIT = "regexp_extract(amount::decimal(38,6)::varchar, '[1-9]')"
_DS = ", ".join(f"count(*) filter ({_DIGIT} = '{k}') as d{k}" for k in range(1, 10))
_ND = "(" + " + ".join(f"d{k}" for k in range(1, 10)) + ")"
_X = lambda n: " + ".join(f"(d{k} - {n} * {s}::double) * (d{k} - {n} * {s}::double) / ({n} * {s}::double)" for k, s in L.BENFORD.items())
_P = "exp(-x / 2) * (1 + x / 2 + (x / 2) * (x / 2) / 2 + (x / 2) * (x / 2) * (x / 2) / 6)"
_ROUND = lambda v: f"abs({v} - round_even({v} * 2, 0) / 2) < 0.001"
_GROUPS = f"""g as (select lab_id, commodity, state, count(*) as n, count(*) filter (pass_fail) as n_pass, count(*) filter ({_ROUND('amount')}) as n_round, {_DS} from ok where test_date >= {months_ago(WINDOW_MONTHS)} group by all),
st as (select state, commodity, avg(case when pass_fail then 1.0 else 0.0 end) as mean, stddev_samp(case when pass_fail then 1.0 else 0.0 end) as dev from ok where test_date >= {months_ago(WINDOW_MONTHS)} group by all),
z as (select g.*, n_pass / n as pass_rate, mean, (n_pass / n - mean) / greatest(coalesce(dev, 0), 0.01) as z from g join st on g.state is not distinct from st.state and g.commodity = st.commodity where n >= {LEAST_TESTS})"""
_REL = f"""x as (select z.*, case when {_ND} >= 30 then {_X(_ND)} else 0 end as x from z),
f as (select *, round(z, 9) > {L.LAB_Z} as o, {_ND} >= 30 and {_P} < 0.05 as b, n_round / n > {L.ROUND_SHARE} as r from x),
s as (select *, (0.80 - case when o then 0.20 else 0 end - case when b then 0.15 else 0 end - case when r then 0.10 else 0 end)::double as reliability,
  concat_ws('; ', case when o then 'pass rate outlier' end, case when b then 'first digits' end, case when r then 'round values' end) as reason from f),
rel as (select lab_id, reliability, commodity, state, n, round(pass_rate, 4) as pass_rate, round(z, 3) as z, reason, reason <> '' as flagged from (select *, row_number() over (partition by lab_id order by reliability, commodity, state) as k from s) where k = 1)"""
_CLUSTER = f"""v as (select lab_id, commodity, ppb, count(*) as k from er where not is_duplicate and test_date >= {months_ago(12)} group by all),
cl as (select lab_id, commodity, sum(k)::bigint as n, arg_max(ppb, (k, -ppb)) as top_ppb, max(k) / sum(k) as share from v group by all)"""
_FLAGS = f"""fl as (select order_id, contaminant_id, part_id, er.lab_id, amount, {_ROUND('er.ppb / 4')} as a, coalesce(rel.flagged, false) as b, coalesce(cl.n >= 10 and cl.share > 0.05, false) as c
  from er left join rel on rel.lab_id = er.lab_id left join cl on cl.lab_id = er.lab_id and cl.commodity = er.commodity and cl.top_ppb = er.ppb where not er.is_duplicate)"""
_IDS = "order_id, contaminant_id, part_id, lab_id, amount"
_SCORES = f"sc as (select {_IDS}, (case when a then 0.10 else 0 end + case when b then 0.25 else 0 end + case when c then 0.20 else 0 end)::double as fraud_score, concat_ws(',', case when a then 'round_value' end, case when b then 'lab' end, case when c then 'cluster' end) as flags from fl)"

ORACLES = {
    "benford_digits": f"with {ER} select lab_id, commodity, {_DS} from ok group by all",
    "benford_chi2": f"""with {ER}, b as (select lab_id, commodity, {_DS} from ok group by all), c as (select *, {_ND} as n from b), e as (select *, case when n >= 30 then {_X('n')} else 0 end as x from c)
select lab_id, commodity, n, round(x, 6) as chi2, round(case when n >= 30 then {_P} else 1 end, 6) as p, n >= 30 and {_P} < 0.05 as suspicious from e""",
    "round_fraction": f"with {ER}, r as (select lab_id, count(*) as n, count(*) filter ({_ROUND('amount')}) as n_round from ok group by all) select *, n_round / n as fraction from r",
    "lab_state_zscore": f"with {ER}, {_GROUPS} select lab_id, commodity, state, n, pass_rate, mean, round(z, 9) as z from z",
    "lab_reliability": f"with {ER}, {_GROUPS}, {_REL} select * from rel",
    "labs_ranked": f"with {ER}, {_GROUPS}, {_REL} select s_suppkey as lab_id, s_name as lab_name, s_suppkey % 3 + 1 as tier, reliability, reason from supplier left join rel on lab_id = s_suppkey order by reliability asc nulls last, s_suppkey limit 50",
    "lab_commodity_stats": f"with {ER} select lab_id, commodity, year(test_date) || '-Q' || quarter(test_date) as quarter, count(*) as n, count(*) filter (pass_fail) as n_pass, count(*) filter ({_ROUND('amount')}) as n_round from ok group by all",
    "value_clusters": f"with {ER}, {_CLUSTER} select *, n >= 10 and share > 0.30 as clustered from cl",
    "record_fraud_scores": f"with {ER}, {_GROUPS}, {_REL}, {_CLUSTER}, {_FLAGS}, {_SCORES} select * from sc",
    "fraud_audit_explode": f"""with {ER}, {_GROUPS}, {_REL}, {_CLUSTER}, {_FLAGS} select {_IDS}, 'round_value' as flag_type, 0.10::double as score from fl where a
union all select {_IDS}, 'lab', 0.25 from fl where b union all select {_IDS}, 'cluster', 0.20 from fl where c""",
    "fraud_records_topk": f"with {ER}, {_GROUPS}, {_REL}, {_CLUSTER}, {_FLAGS}, {_SCORES} select * from sc where fraud_score >= 0.20 order by fraud_score desc, {_IDS} limit 100",
    "geo_node_counts": f"""with {ER}, n as (select s_nationkey, count(*) as n_nodes from supplier group by all), e as (select district_id, commodity, count(*) as n_tests from er group by all)
select district_id, commodity, n_tests, coalesce(n_nodes, 0) as n_nodes from e left join n on s_nationkey = district_id""",
}
