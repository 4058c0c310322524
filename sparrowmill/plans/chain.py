"""Supply chain, upserts, disputes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.operators import graph, upsert
from sparrowmill.plans.views import AGG, ER, facts, months_ago, quarters, since, usable
from sparrowmill.storage import table, written


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, suppliers and brands; a nation with results of the last year for one commodity is measured."""
    er = facts(spark, d).where(usable() & since(12) & (F.col("commodity") == "PROMO"))
    m = er.groupBy((F.col("district_id") + 1000).cast("long").alias("node")).agg((F.sum(F.col("ppb").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("measured"), F.count(F.lit(1)).alias("n_tests"))
    ids = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node"))
    ids = ids.union(table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long")))
    ids = ids.union(table(spark, d, "supplier").select((F.col("s_suppkey") + 10000).cast("long")))
    ids = ids.union(table(spark, d, "part").select((F.substring_index("p_brand", "#", -1).cast("long") + 10000000)).distinct())
    return ids.join(m, "node", "left").select("node", "measured", F.coalesce("n_tests", F.lit(0)).alias("n_tests"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Region to nation to supplier to the brands that it delivers; losses and trust from keys, some missing."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("source"), (F.col("n_nationkey") + 1000).cast("long").alias("target"))
    s = table(spark, d, "supplier").select((F.col("s_nationkey") + 1000).cast("long").alias("source"), (F.col("s_suppkey") + 10000).cast("long").alias("target"))
    brands = table(spark, d, "part").select("p_partkey", (F.substring_index("p_brand", "#", -1).cast("long") + 10000000).alias("target"))
    b = table(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") + 10000).cast("long").alias("source")).join(brands, F.col("l_partkey") == F.col("p_partkey")).select("source", "target").distinct()
    both = n.union(s).union(b)
    lost, trust = (F.col("source") + F.col("target")) % 5, (F.col("source") * 3 + F.col("target")) % 4
    return both.select("source", "target", F.when(lost > 0, 1 - lost / 10).alias("retention"), F.when(trust > 0, trust / 4).alias("link"))


def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(nodes(spark, d), graph.clean_edges(edges(spark, d), nodes(spark, d)))


def graph_ancestors(spark: SparkSession, d: str, node: int = 10000011) -> DataFrame:
    return graph.ancestors(written(edges(spark, d), "edges"), node)


def graph_propagation(spark: SparkSession, d: str, blend: bool = False) -> DataFrame:
    all_nodes = written(nodes(spark, d), "nodes")
    out = graph.propagate(all_nodes, written(graph.clean_edges(edges(spark, d), all_nodes), "edges"), blend=blend)
    return out.select("node", F.round("estimate", 9).alias("estimate"), F.round("confidence", 9).alias("confidence"), "source")


def graph_blended(spark: SparkSession, d: str) -> DataFrame:
    """Brands are measured too, by results of their own, and every measured node with estimated predecessors is blended with them."""
    er = facts(spark, d).where(usable() & F.col("brand").isNotNull() & (F.col("contaminant_id") == 1))
    own = er.groupBy((F.substring_index("brand", "#", -1).cast("long") + 10000000).alias("node")).agg((F.sum(F.col("ppb").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("of_brand"), F.count(F.lit(1)).alias("n"))
    base = nodes(spark, d).join(own, "node", "left")
    all_nodes = written(base.select("node", F.coalesce("of_brand", "measured").alias("measured"), F.coalesce("n", "n_tests").alias("n_tests")), "nodes")
    out = graph.propagate(all_nodes, written(graph.clean_edges(edges(spark, d), all_nodes), "edges"), blend=True)
    return out.select("node", F.round("estimate", 9).alias("estimate"), F.round("confidence", 9).alias("confidence"), "source")


def upsert_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of all but the last year, updated by those of the last year; bounds of old rows stay, new ones get 0."""
    er = facts(spark, d)
    old = quarters(er.where(~since(12))).withColumn("upper", F.col("risk_score") + 5)
    keys, moved = ["district_id", "commodity", "quarter"], ["n_tests", "fail_rate", "risk_score"]
    return upsert.upsert(old, quarters(er.where(since(15))), keys, moved, {"upper": 0.0})


def insert_absent_keys(spark: SparkSession, d: str) -> DataFrame:
    """Brands known so far (of small parts) with ids, and the others numbered after them."""
    part = table(spark, d, "part")
    old = part.where("p_size <= 1").select(F.col("p_brand").alias("name")).distinct().select((F.substring_index("name", "#", -1).cast("int")).alias("id"), "name")
    return upsert.insert_absent(old, part.select(F.col("p_brand").alias("name")), "name", "id")


def dispute_status(spark: SparkSession, d: str) -> DataFrame:
    """Per brand: disputes ever, open ones, and whether it is under dispute; derived from the stream of events."""
    ev = table(spark, d, "events")
    acts = ev.select((F.col("user_id") % 25).alias("brand_id"), F.col("event_id"), F.when(F.col("event_type") == "click", "submitted").when(F.col("event_type") == "error", "resolved_removed").when(F.col("event_type") == "purchase", "resolved_upheld").alias("act")).where("act is not null")
    g = acts.groupBy("brand_id").agg(F.count_if(F.col("act") == "submitted").alias("dispute_count"), F.count_if(F.col("act") != "submitted").alias("n_resolved"), F.max("event_id").alias("last_event"))
    return g.withColumn("n_open", F.greatest(F.col("dispute_count") - F.col("n_resolved"), F.lit(0))).withColumn("under_dispute", F.col("dispute_count") > F.col("n_resolved"))


QUERIES = {f.__name__: f for f in (graph_levels, graph_ancestors, graph_propagation, graph_blended, upsert_aggregate, insert_absent_keys, dispute_status)}

_EDGES = """e0 as (select n_regionkey::bigint as source, (n_nationkey + 1000)::bigint as target from nation union all select (s_nationkey + 1000)::bigint, (s_suppkey + 10000)::bigint from supplier
  union all select distinct (l_suppkey + 10000)::bigint, split_part(p_brand, '#', 2)::bigint + 10000000 from lineitem join part on l_partkey = p_partkey),
e as (select source, target, case when (source + target) % 5 > 0 then 1 - ((source + target) % 5) / 10 else 1 end as retention, case when (source * 3 + target) % 4 > 0 then ((source * 3 + target) % 4) / 4 else 0.5 end as link from e0)"""
_NODES = f"""m as (select (district_id + 1000)::bigint as node, sum(ppb::decimal(18,2))::double / count(*) as measured, count(*) as n from ok where test_date >= {months_ago(12)} and commodity = 'PROMO' group by all),
nd as (select node, measured, coalesce(n, 0) as n from (select r_regionkey::bigint as node from region union all select (n_nationkey + 1000)::bigint from nation union all select (s_suppkey + 10000)::bigint from supplier
  union all select distinct split_part(p_brand, '#', 2)::bigint + 10000000 from part) left join m using (node))"""
_LEVEL = """lv as (select node, case when node < 1000 then 0 when node < 10000 then 1 when node < 10000000 then 2 when node in (select target from e) then 3 else 0 end as level from nd)"""


def _step(k: int) -> str:
    """Estimates at level k from those of all lower levels."""
    before = " union all ".join(f"select * from p{j}" for j in range(k))
    into = f"select target as node, sum(estimate * retention * confidence * link) as pull, sum(confidence * link) as w, count(*) as k from e join ({before}) b on b.node = e.source where estimate is not null group by target" if k else "select null::bigint as node, null::double as pull, null::double as w, null::bigint as k"
    return f"""p{k} as (select nd.node, case when n > 0 then measured when w > 0 then pull / w end as estimate, case when n > 0 then least(0.90, 0.60 + 0.03 * least(10, n)) when w > 0 then least(0.60, w / k) else 0 end as confidence,
  case when n > 0 then 'measured' when w > 0 then 'propagated' else 'none' end as source from nd join lv using (node) left join ({into}) i on i.node = nd.node where level = {k})"""


def _blended(k: int) -> str:
    """As _step, but measured nodes with a prior are a mean of both."""
    before = " union all ".join(f"select * from p{j}" for j in range(k))
    into = f"select target as node, sum(estimate * retention * confidence * link) as pull, sum(confidence * link) as w, count(*) as k from e join ({before}) b on b.node = e.source where estimate is not null group by target" if k else "select null::bigint as node, null::double as pull, null::double as w, null::bigint as k"
    share = f"least({graph.OWN_MOST}, {graph.OWN_EACH} * n)"
    return f"""p{k} as (select nx.node, case when n > 0 and w > 0 then (1 - {share}) * pull / w + {share} * measured when n > 0 then measured when w > 0 then pull / w end as estimate,
  case when n > 0 and w > 0 then least(0.90, w / k + {graph.SURE_EACH} * n) when n > 0 then least(0.90, 0.60 + 0.03 * least(10, n)) when w > 0 then least(0.60, w / k) else 0 end as confidence,
  case when n > 0 and w > 0 then 'mixed' when n > 0 then 'measured' when w > 0 then 'propagated' else 'none' end as source from nx join lv using (node) left join ({into}) i on i.node = nx.node where level = {k})"""


_OWN = """ow as (select split_part(brand, '#', 2)::bigint + 10000000 as node, sum(ppb::decimal(18,2))::double / count(*) as of_brand, count(*) as own from ok where brand is not null and contaminant_id = 1 group by all),
nx as (select node, coalesce(of_brand, measured) as measured, coalesce(own, n) as n from nd left join ow using (node))"""

ORACLES = {
    "graph_levels": f"with {ER}, {_NODES}, {_EDGES}, {_LEVEL} select node, level from lv",
    "graph_ancestors": f"with recursive {_EDGES}, a as (select 10000011::bigint as node, 0 as distance union select source, distance + 1 from a join e on target = node) select node, min(distance) as distance from a where distance > 0 group by node",
    "graph_propagation": f"with {ER}, {_NODES}, {_EDGES}, {_LEVEL}, {', '.join(_step(k) for k in range(4))} select node, round(estimate, 9) as estimate, round(confidence, 9)::double as confidence, source from ({' union all '.join(f'select * from p{k}' for k in range(4))})",
    "graph_blended": f"with {ER}, {_NODES}, {_OWN}, {_EDGES}, {_LEVEL}, {', '.join(_blended(k) for k in range(4))} select node, round(estimate, 9) as estimate, round(confidence, 9)::double as confidence, source from ({' union all '.join(f'select * from p{k}' for k in range(4))})",
    "upsert_aggregate": f"""with {ER}, {AGG.replace('agg as', 'old as').replace('from ok where', f'from ok where not test_date >= {months_ago(12)} and')}, {AGG.replace('agg as', 'new as').replace('from ok where', f'from ok where test_date >= {months_ago(15)} and')}
select coalesce(n.district_id, o.district_id) as district_id, coalesce(n.commodity, o.commodity) as commodity, coalesce(n.quarter, o.quarter) as quarter, coalesce(n.n_tests, o.n_tests) as n_tests, coalesce(n.fail_rate, o.fail_rate) as fail_rate,
coalesce(n.risk_score, o.risk_score) as risk_score, coalesce(o.risk_score + 5, 0)::double as upper from old o full join new n on o.district_id = n.district_id and o.commodity = n.commodity and o.quarter = n.quarter""",
    "insert_absent_keys": """with o as (select distinct split_part(p_brand, '#', 2)::int as id, p_brand as name from part where p_size <= 1), f as (select distinct p_brand as name from part where p_brand not in (select name from o))
select * from o union all select ((select coalesce(max(id), 0) from o) + row_number() over (order by name))::int, name from f""",
    "dispute_status": """with a as (select user_id % 25 as brand_id, event_id, case event_type when 'click' then 's' when 'error' then 'r' when 'purchase' then 'u' end as act from events),
g as (select brand_id, count(*) filter (act = 's') as dispute_count, count(*) filter (act <> 's') as n_resolved, max(event_id) as last_event from a where act is not null group by brand_id)
select *, greatest(dispute_count - n_resolved, 0)::bigint as n_open, dispute_count > n_resolved as under_dispute from g""",
}
