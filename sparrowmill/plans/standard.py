"""Standardising raw fields, duplicates, confidence: the ingest stages over raw texts.

The test tables hold clean values, so raw() spells them as reports would, in
different manners by contaminant number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S
from sparrowmill.operators import fuzzy
from sparrowmill.plans.views import CONTAMINANTS, ER, facts, months_ago, since, usable
from sparrowmill.storage import table

UNITS = ("ppb", "ppm", "mg/kg dry", "%", "kg", "furlong", "MG/L")
DATES = ("dd/MM/yyyy", "yyyy-MM-dd", "d-M-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MM/yyyy", "'x'yyyy")
VERDICTS = ("Pass", "FAILED", "Not safe", "unsatisfactory", "Conforming", "P", "")
STATES = ("MH", " orissa ", "NCT of Delhi", "ladakh", "tamilnadu", "", "Goa")
FOODS = ("Basmati Rice", "groundnut oil", "mustard oil", "Fish curry", "licorice", "mystery", "Milk")
LABS = ("NABL Ref Lab Pune", "CFTRI Mysuru", "Mining Lab", "Unknown", "icar-x", "Lab 6", "Niftem")


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), key)


def written_day(day: Column | str, formats: tuple[str, ...], number: Column) -> Column:
    """A day in the format with this number, from 1; the others aren't made."""
    return S.first_match([(number == k, F.date_format(day, f)) for k, f in enumerate(formats, 1)])


def _day() -> Column:
    return F.col("l_shipdate").cast("date").cast("string")


def _value() -> Column:
    return F.format_string("%,d", F.col("l_extendedprice").cast("bigint"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spelt(table(spark, d, "lineitem"))


def spelt(lines: DataFrame, *more: str) -> DataFrame:
    """Lines as reports would spell them, with more of their columns."""
    n = F.col("l_linenumber")
    return lines.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("lab_id"), n.alias("line"), F.col("l_quantity").alias("quantity"), _day().alias("day"),
        _value().alias("value"), _pick(UNITS, n).alias("unit"), written_day("l_shipdate", DATES, n).alias("date"), _pick(VERDICTS, n).alias("verdict"),
        _pick(STATES, n).alias("state"), _pick(FOODS, n).alias("food"), _pick(LABS, n).alias("lab"), *more,
    )


def _sql_pick(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "][l_linenumber]"


_D = "l_shipdate"
RAW = f"""raw as (select l_orderkey as order_id, l_partkey as part_id, l_suppkey as lab_id, l_linenumber as line, l_quantity as quantity, l_shipdate::date::varchar as day,
  format('{{:,}}', trunc(l_extendedprice)::bigint) as value, {_sql_pick(UNITS)} as unit,
  [strftime({_D}, '%d/%m/%Y'), strftime({_D}, '%Y-%m-%d'), strftime({_D}, '%-d-%-m-%Y'), strftime({_D}, '%-d %B %Y'), strftime({_D}, '%b %-d, %Y'), strftime({_D}, '%m/%Y'), 'x' || strftime({_D}, '%Y')][l_linenumber] as date,
  {_sql_pick(VERDICTS)} as verdict, {_sql_pick(STATES)} as state, {_sql_pick(FOODS)} as food, {_sql_pick(LABS)} as lab from lineitem)"""
_KEY = ("order_id", "part_id", "lab_id", "line", "day", "quantity")
_K = ", ".join(_KEY)


def units_to_ppb(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(*_KEY, S.unit_to_ppb(F.col("value"), F.col("unit")).alias("ppb"))


def dates_standardised(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(*_KEY, S.parse_date(F.col("date")).cast("string").alias("parsed"), S.date_is_ambiguous(F.col("date")).alias("ambiguous"))


def pass_fail_norm(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(*_KEY, S.normalise_pass_fail(F.col("verdict")).alias("passed"))


def pass_fail_inferred(spark: SparkSession, d: str) -> DataFrame:
    verdict = S.normalise_pass_fail(F.col("verdict"))
    return raw(spark, d).select(*_KEY, S.infer_pass_fail(verdict, F.col("quantity"), F.lit(25.0)).alias("passed"))


def state_canonical(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(*_KEY, S.canonical_state(F.col("state")).alias("state"))


def state_hints(spark: SparkSession, d: str) -> DataFrame:
    """A state guessed from a title."""
    title = F.concat(F.lit("Report "), F.col("state"), F.lit(" of "), F.col("food"))
    return raw(spark, d).select(*_KEY, S.state_in_title(title).alias("hint"))


def category_resolved(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(*_KEY, S.commodity_category(F.col("food")).alias("category"), S.lab_tier(F.col("lab")).cast("string").alias("tier"))


def email_redacted(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.substring_index("c_name", "#", 1))
    address = F.when(F.col("c_custkey") % 3 == 0, name).when(F.col("c_custkey") % 3 == 1, F.concat(name, F.lit("@x.com"))).otherwise(F.lit("a@b@c"))
    return table(spark, d, "customer").select("c_custkey", S.redact_email(address).alias("address"))


def _hashed(er: DataFrame, any_day_or_lab: bool = False) -> DataFrame:
    """any_day_or_lab: hash only what was found where, so that like findings of other days are equal."""
    day, lab = (F.lit(None), F.lit(None)) if any_day_or_lab else (F.col("test_date"), F.col("lab_id"))
    h = S.dedup_hash(day, lab, F.col("commodity"), F.col("contaminant_id"), F.col("ppb"), F.col("district_id"))
    return er.select("order_id", "contaminant_id", "part_id", "lab_id", "amount", F.col("test_date").cast("string").alias("test_date"), h.alias("hash"))


def dedup_flags(spark: SparkSession, d: str) -> DataFrame:
    """The first of equal hashes, in ingest order, is the original. Hashes are spread, so a hot one is a rare case of equal results."""
    order = Window.partitionBy("hash").orderBy("order_id", "contaminant_id", "part_id", "lab_id", "amount")
    return _hashed(facts(spark, d, flags=False)).withColumn("is_duplicate", F.row_number().over(order) > 1)


def dedup_history_semi(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the last year that were already found, at the same place, before it."""
    er = facts(spark, d, flags=False)
    return _hashed(er.where(since(12)), True).join(_hashed(er.where(~since(12)), True).select("hash").distinct(), "hash", "left_semi")


def already_seen_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose address is not among those fetched before (here: every third)."""
    pages = table(spark, d, "pages")
    return pages.select("page_id", "url").join(pages.where("page_id % 3 = 0").select("url"), "url", "left_anti")


def _contaminant(key: Column) -> Column:
    return _pick(CONTAMINANTS, key)


def typical_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Range join on a dimension of a dozen rows."""
    ranges = spark.createDataFrame([(c, g, lo, hi) for (c, g), (lo, hi) in L.TYPICAL_RANGES.items()], "contaminant string, category string, lo double, hi double")
    rows = raw(spark, d).select(*_KEY, _contaminant(F.col("line")).alias("contaminant"), S.commodity_category(_pick(FOODS, F.pmod("part_id", F.lit(7)).cast("int") + 1)).alias("category"), (F.col("quantity") * 20).alias("ppb"))
    inside = F.coalesce(F.col("ppb").between(F.col("lo"), F.col("hi")), F.lit(False))
    return rows.join(ranges, ["contaminant", "category"], "left").select(*_KEY, "contaminant", "category", "ppb", inside.alias("in_range"))


def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = typical_range_join(spark, d)
    ocr = F.when(F.pmod("order_id", F.lit(4)) == 0, 0.79).otherwise(0.95)
    tier1 = F.coalesce(S.lab_tier(_pick(LABS, F.pmod("lab_id", F.lit(7)).cast("int") + 1)) == 1, F.lit(False))
    score = S.confidence(tier1, F.col("in_range"), ocr, F.pmod("order_id", F.lit(10)) == 0)
    return rows.select(*_KEY, score.cast("double").alias("confidence"), (score >= L.USABLE).alias("is_usable"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a run in one pass."""
    return facts(spark, d).agg(F.count(F.lit(1)).alias("records"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(usable()).alias("usable"), F.count_if(F.col("pass_fail").isNull()).alias("unknown"))


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a constraint, with the names of those broken."""
    checks = {"confidence": ~F.col("confidence_score").between(0, 1), "value": F.col("ppb") > 49, "verdict": F.col("pass_fail").isNull() & (F.col("amount") > 90000)}
    broken = F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])), ",")
    return facts(spark, d, flags=False).select("order_id", "contaminant_id", "part_id", "lab_id", "amount", broken.alias("broken")).where("broken <> ''")


def fuzzy_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt contaminant names, matched to aliases by token-sorted similarity of 80 or more."""
    names = list(L.CONTAMINANT_ALIASES)
    misspelt = F.transform(F.array(*[F.lit(x) for x in names]), lambda x: F.concat(F.substring(x, 1, 4), F.lit("x"), F.substring(x, 6, 40)))
    pick = F.element_at(misspelt, (F.pmod("part_id", F.lit(len(names))) + 1).cast("int"))
    rows = raw(spark, d).select(*_KEY, F.when(F.col("line") % 2 == 0, pick).otherwise(F.initcap(F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod("part_id", F.lit(len(names))) + 1).cast("int")))).alias("name"))
    aliases = spark.createDataFrame([(n, a, c) for n, (a, c) in enumerate(L.CONTAMINANT_ALIASES.items())], "rank int, alias string, canonical string")
    return fuzzy.canonicalise(rows, "name", aliases, 80.0).select(*_KEY, "name", "canonical", "score")


QUERIES = {
    f.__name__: f
    for f in (
        units_to_ppb, dates_standardised, pass_fail_norm, pass_fail_inferred, state_canonical, state_hints, category_resolved, email_redacted, dedup_flags, dedup_history_semi,
        already_seen_anti, typical_range_join, confidence_scores, run_summary, quarantined, fuzzy_canonical,
    )
}


def _chain(pairs, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_U = "regexp_replace(lower(trim(unit)), '[µμ]', 'u', 'g')"
_UNIT = _chain([(f"{_U} = {_q(k)}", repr(v)) for k, v in L.UNIT_TO_PPB.items()] + [(f"contains({_U}, {_q(k)}) or contains({_q(k)}, {_U})", repr(v)) for k, v in L.UNIT_TO_PPB.items()])
_PASS = "case when regexp_matches(lower(verdict), 'pass|satisfactory|conforming|safe|compliant') then not regexp_matches(lower(verdict), 'not|un|non|fail') when contains(lower(verdict), 'fail') then false end"
_STATE = _chain([(f"lower(trim(state)) in ({', '.join(map(_q, names))})", _q(s)) for s, names in L.STATES.items()], "upper(left(state, 1)) || lower(substr(state, 2))")
_CATEGORY = lambda x: _chain([(f"contains(lower(trim({x})), {_q(w)})", _q(c)) for w, c in L.CATEGORY_WORDS.items()])
_TIER = lambda x: _chain([(f"contains(lower({x}), {_q(w)})", "1") for w in L.TIER1_KEYWORDS])
_LIST = lambda v: "[" + ", ".join(map(_q, v)) + "]"
_HASH = "sha256(concat_ws('|', test_date::varchar, lab_id::varchar, lower(trim(commodity)), contaminant_id::varchar, ppb::decimal(38,3)::varchar, district_id::varchar))"
_HASHED = f"h as (select order_id, contaminant_id, part_id, lab_id, amount, test_date::varchar as test_date, {_HASH} as hash from er)"
_FOUND = _HASHED.replace("test_date::varchar, lab_id::varchar,", "'', '',")
_RANGES = ", ".join(f"({_q(c)}, {_q(g)}, {lo!r}::double, {hi!r}::double)" for (c, g), (lo, hi) in L.TYPICAL_RANGES.items())
_TYPICAL = f"""tr as (select {_K}, contaminant, category, ppb, coalesce(ppb between lo and hi, false) as in_range from (
  select {_K}, {_LIST(CONTAMINANTS)}[line] as contaminant, {_CATEGORY(_LIST(FOODS) + '[part_id % 7 + 1]')} as category, quantity * 20 as ppb from raw)
  left join (values {_RANGES}) v(c, g, lo, hi) on c = contaminant and g = category)"""

ORACLES = {
    "units_to_ppb": f"with {RAW} select {_K}, try_cast(replace(value, ',', '') as double) * {_UNIT} as ppb from raw",
    "dates_standardised": f"""with {RAW} select {_K}, case when line <= 5 then day when line = 6 then left(day, 7) || '-01' end as parsed,
line in (1, 3) and day(day::date) <= 12 and day(day::date) <> month(day::date) as ambiguous from raw""",
    "pass_fail_norm": f"with {RAW} select {_K}, {_PASS} as passed from raw",
    "pass_fail_inferred": f"with {RAW} select {_K}, coalesce({_PASS}, quantity <= 25) as passed from raw",
    "state_canonical": f"with {RAW} select {_K}, case when state <> '' then {_STATE} end as state from raw",
    "state_hints": f"with {RAW} select {_K}, {_chain([(f'contains(lower(t), {_q(a)})', _q(s)) for a, s in L.STATE_ALIASES.items()])} as hint from (select *, 'Report ' || state || ' of ' || food as t from raw)",
    "category_resolved": f"with {RAW} select {_K}, {_CATEGORY('food')} as category, ({_TIER('lab')})::varchar as tier from raw",
    "email_redacted": """select c_custkey, case c_custkey % 3 when 0 then 'cu***@***' when 1 then 'cu***@x.com' else 'a***@b' end as address from customer""",
    "dedup_flags": f"with {ER}, {_HASHED} select *, row_number() over (partition by hash order by order_id, contaminant_id, part_id, lab_id, amount) > 1 as is_duplicate from h",
    "dedup_history_semi": f"with {ER}, {_FOUND} select * from h where test_date::date >= {months_ago(12)} and hash in (select hash from h where test_date::date < {months_ago(12)})",
    "already_seen_anti": "select page_id, url from pages where url not in (select url from pages where page_id % 3 = 0)",
    "typical_range_join": f"with {RAW}, {_TYPICAL} select * from tr",
    "confidence_scores": f"""with {RAW}, {_TYPICAL}, s as (select {_K}, (0.70 + case when order_id % 10 = 0 then 0.15 else 0 end + case when {_TIER(_LIST(LABS) + '[lab_id % 7 + 1]')} = 1 then 0.10 else 0 end
+ case when in_range then 0.05 else 0 end - case when order_id % 4 = 0 then 0.10 else 0 end)::decimal(5,3) as c from tr) select {_K}, least(greatest(c, 0), 1)::double as confidence, c >= 0.75 as is_usable from s""",
    "run_summary": f"with {ER} select count(*) as records, count(*) filter (is_duplicate) as duplicates, count(*) filter (confidence_score >= 0.75 and not is_duplicate) as usable, count(*) filter (pass_fail is null) as unknown from er",
    "quarantined": f"""with {ER}, b as (select order_id, contaminant_id, part_id, lab_id, amount, concat_ws(',', case when confidence_score not between 0 and 1 then 'confidence' end, case when ppb > 49 then 'value' end,
case when pass_fail is null and amount > 90000 then 'verdict' end) as broken from er) select * from b where broken <> ''""",
}
