"""Names and raw inputs: districts, alias dictionaries, categories, loose dates, listings, recognised pages, the forest's figures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S
from sparrowmill.operators import forest, ingest, places
from sparrowmill.operators.similar import similar
from sparrowmill.plans import risk, standard
from sparrowmill.plans.standard import _CATEGORY, _K, _KEY, RAW, _q, raw
from sparrowmill.plans.views import AS_OF, ER, facts
from sparrowmill.sources import formats
from sparrowmill.storage import shared_dir, table, written

#: A dimension of districts: id, name, state, other names; the last two share a name.
DISTRICTS = (
    (1, "Ahmedabad", "Gujarat", ("Amdavad",)), (2, "Coimbatore", "Tamil Nadu", ()), (3, "Bengaluru Urban", "Karnataka", ("Bangalore",)), (4, "Pune", "Maharashtra", ("Poona",)),
    (5, "Aurangabad", "Maharashtra", ("Sambhajinagar",)), (6, "Aurangabad", "Bihar", ()),
)
SPELT = ("ahmadabad", " Coimbatur ", "bangalore", "urban bengalru", "Aurangabad", "aurangbad", "", "Poona", "Atlantis", "AURANGABAD")
IN_STATE = ("Gujarat", "", "Karnataka", "", "Bihar", "Maharashtra", "Goa", "Maharashtra", "", "")
LOOSE = ("%d-%b-%Y", "%b %Y", "%a, %d %b %Y 10:20:30 GMT", "%Y-%m-%d", "%d/%m/%Y", "x%Y", "%Y/%b")
_LOOSE = ("dd-MMM-yyyy", "MMM yyyy", "EEE, dd MMM yyyy '10:20:30 GMT'", "yyyy-MM-dd", "dd/MM/yyyy", "'x'yyyy", "yyyy/MMM")
#: A table of contaminants and one of commodities, as a warehouse would add to the fixed ones.
CONTAMINANT_TABLE = ((1, "lead", ("Pb2+", "Blei")), (2, "melamine", ("MEL",)), (3, "nickel", ("pb", "ni")))
COMMODITY_TABLE = ((1, "mystery mix", "packaged", ("unknown mix",)), (2, "ragi", "grain", ("Mandua",)), (3, "big mystery", "meat", ()))


def _spelt(values: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("part_id", F.lit(len(values))) + 1).cast("int"))


def districts_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt districts, some with their state."""
    dimension = spark.createDataFrame([(i, n, s, list(a)) for i, n, s, a in DISTRICTS], "id int, name string, state string, alternate_names array<string>")
    rows = raw(spark, d).select(*_KEY, _spelt(SPELT).alias("district"), _spelt(IN_STATE).alias("state"))
    return places.resolve_districts(rows, dimension)


def similarity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Token-sorted similarity of each part's name to each alias of a contaminant."""
    aliases = F.explode(F.array(*[F.lit(a) for a in L.CONTAMINANT_ALIASES]))
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("alias", aliases)
    return names.select("name", "alias", F.round(S.similarity(S.sort_tokens(F.col("name")), S.sort_tokens(F.col("alias"))), 6).alias("score"))


def names_alike(spark: SparkSession, d: str, least: float = 75.0) -> DataFrame:
    """Names of parts that are like the name of a part with its type, by token-sorted similarity."""
    part = table(spark, d, "part")
    long = part.select(S.sort_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("a"))
    return similar(long, part.select(S.sort_tokens(F.col("p_name")).alias("b")), least).select("a", "b", F.round("score", 6).alias("score"))


def dates_loose(spark: SparkSession, d: str) -> DataFrame:
    shown = standard.written_day("day", _LOOSE, F.col("line"))
    found = raw(spark, d).withColumn("day", F.col("day").cast("date")).select(*[c if c != "day" else F.col("day").cast("string").alias("day") for c in _KEY], S.parse_date_loosely(shown).alias("f"))
    return found.select(*_KEY, F.col("f.day").cast("string").alias("parsed"), F.col("f.ambiguous").alias("ambiguous"))


def _aliases(spark: SparkSession) -> DataFrame:
    fixed = spark.createDataFrame([(n, a, c) for n, (a, c) in enumerate(L.CONTAMINANT_ALIASES.items())], "rank int, alias string, canonical string")
    more = spark.createDataFrame([(i, n, list(a)) for i, n, a in CONTAMINANT_TABLE], "id int, name string, aliases array<string>")
    return places.alias_dictionary(fixed, more)


def alias_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _aliases(spark).select("alias", "canonical")


def categories_by_table(spark: SparkSession, d: str) -> DataFrame:
    goods = spark.createDataFrame([(i, n, c, list(a)) for i, n, c, a in COMMODITY_TABLE], "id int, name string, category string, aliases array<string>")
    names = raw(spark, d).select(*_KEY, _spelt(("Basmati Rice", "mystery", "Mandua", "unknown mix", "nothing", "Milk", "")).alias("name"))
    return places.categories_by_table(names, goods)


def listing_links(spark: SparkSession, d: str) -> DataFrame:
    """Listings of a dozen pages, each with two reports of its own and one of the page before; the eighth has nothing new."""
    n = F.col("page_id") + 1
    link = lambda k, more="": F.concat(F.lit("<a href='/files/r"), k.cast("string"), F.lit(f".PDF' {more}>"))
    own = F.when(n == 8, F.lit("")).otherwise(F.concat(link(2 * n), F.lit("Report Goa</a>"), link(2 * n + 1, 'title="Delhi report"'), F.lit("</a>")))
    html = F.concat(F.lit("<html>"), own, link(2 * n - 2), F.lit("again</a></html>"))
    pages = table(spark, d, "pages").where("page_id < 12").select(n.cast("int").alias("page_no"), F.lit("http://host/list").alias("url"), html.alias("html"))
    return formats.listed_links(pages)


def feed_of_country(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/INDIA"))).otherwise(F.col("url")).alias("link"), F.when(F.col("page_id") % 5 == 0, F.lit("India")).alias("state"))
    return formats.of_country(items)


def landed_paths(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    return table(spark, d, "pages").select("page_id", formats.landed_path(F.lit("fssai"), F.lit("list"), F.col("url")).alias("local"), formats.landed_path(F.lit("fssai"), F.lit("list"), F.col("url"), day).alias("remote"))


def entities_routed(spark: SparkSession, d: str) -> DataFrame:
    one = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    found = F.array(one("GPE", F.col("n_name")), one("ORG", F.lit("Acme")), one("DATE", F.lit("2024")), one("ORG", F.lit("Other")), one("GPE", F.lit("Pune")), one("PERSON", F.lit("x")))
    found = F.when(F.col("n_nationkey") % 2 == 0, found).otherwise(F.slice(found, 2, 3))
    return formats.routed_entities(table(spark, d, "nation").select("n_nationkey", found.alias("e")), "e").drop("e")


def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Words read on a page, here the lines of an order: text and mean confidence of those that count."""
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_url"), F.lit(1).alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"), (F.col("l_quantity") - 10).alias("conf"))
    return formats.mean_confidence(words)


def pages_recognised(spark: SparkSession, d: str) -> DataFrame:
    """Pages through a reader, the unsure ones through another; documents with a table of records skip it."""

    def primary(image: bytes) -> tuple[str, float]:
        return image.decode(), 0.5 if image.endswith(b"7") else 0.9

    def fallback(image: bytes) -> tuple[str, float]:
        return "Cadmium 9 ppb", 0.7

    images = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_url"), F.lit(1).alias("page"), F.concat(F.lit("Lead "), F.col("p_size").cast("string"), F.lit(" ppb in "), F.col("p_type"), F.lit(" no. "), F.col("p_partkey").cast("string")).cast("binary").alias("image"))
    tables = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("source_url"), F.lit("lead").alias("contaminant"), F.lit("1").alias("value"), F.lit("ppb").alias("unit"), *[F.lit(None).cast("string").alias(c) for c in ("date", "state", "lab_id")])
    return formats.documents_or_pages(tables, formats.recognised(images, primary, fallback)).select("source_url", "contaminant", "value", "unit", "conf")


def facts_stored(spark: SparkSession, d: str) -> DataFrame:
    """Results appended by year and read back from a day on, of pruned years only."""
    rows = facts(spark, d, flags=False).select("order_id", F.when(F.col("order_id") % 9 > 0, F.col("commodity")).alias("commodity"), F.col("contaminant_id").cast("string").alias("contaminant"), "ppb", "test_date", "amount")
    path = f"{shared_dir(spark)}/tables/facts-{uuid.uuid4().hex}"
    ingest.append_facts(rows, path, AS_OF)
    return ingest.facts_since(spark.read.parquet(path), "2000-06-01").select("order_id", "commodity", "contaminant", "ppb", F.col("test_date").cast("string").alias("test_date"), "amount")


def forest_figures(spark: SparkSession, d: str, folds: int = 10, fold_trees: int = 200, trees: int = 300) -> DataFrame:
    """Figures of folds in time and the three most important features, of a forest that was saved and loaded."""
    rows = written(risk.risk_features(spark, d), "features")
    model, held = forest.fit(rows, ("AFRICA", "ASIA"), trees=trees)
    path = f"{shared_dir(spark)}/tables/forest-{uuid.uuid4().hex}"
    forest.save(model, path)
    cv, top = forest.cross_validated(rows, folds, fold_trees), forest.top_importances(forest.load(path))
    figures = [("cv_auc_mean", cv["auc_mean"]), ("cv_auc_std", cv["auc_std"]), *((f"held_out_{k}", v) for k, v in held.items()), *((f"importance_{n}", v) for n, v in top)]
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in figures], "figure string, value double")


QUERIES = {
    f.__name__: f
    for f in (
        districts_resolved, similarity_scores, names_alike, dates_loose, alias_dictionary, categories_by_table, listing_links, feed_of_country, landed_paths, entities_routed, page_confidence, pages_recognised, facts_stored, forest_figures,
    )
}

_SORTED = lambda x: f"array_to_string(list_sort(list_filter(string_split(lower(trim({x})), ' '), lambda w: w <> '')), ' ')"


def similarity_sql(a: str, b: str) -> str:
    """200 times the longest common subsequence over both lengths, of two columns in token order: rows of the usual table, one for each letter of a."""
    hits = f"list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda x: (c = x)::int))"
    zero = f"list_transform(string_split({b}, ''), lambda x: 0)"
    row = "list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k], m[k] * (coalesce(acc[k - 1], 0) + 1)))))"
    return f"(200.0::double * list_reduce(list_prepend({zero}, {hits}), lambda acc, m: {row})[-1] / (length({a}) + length({b})))"


_P = lambda values: "[" + ", ".join(map(_q, values)) + f"][part_id % {len(values)} + 1]"
_DIM = ", ".join(f"({i}, {_q(n)}, {_q(s)}, [{', '.join(map(_q, (n, *a)))}])" for i, n, s, a in DISTRICTS)
_DAY = "day::date"

ORACLES = {
    "districts_resolved": f"""with {RAW}, r as (select {_K}, {_P(SPELT)} as district, {_P(IN_STATE)} as state from raw), dim(id, name, st, names) as (values {_DIM}), v as (select id, name, st, lower(unnest(names)) as x from dim),
n as (select distinct lower(trim(district)) as k, nullif(state, '') as s from r where trim(district) <> ''),
e as (select k, s, arg_max(id, id) as id, arg_max(name, id) as name, 100.0::double as score from n join v on k = x and (s is null or s = st) group by k, s),
c as (select k, s, id, name, {_SORTED('k')} as a, {_SORTED('x')} as b from n join v on s is null or s = st where not exists (select 1 from e where e.k = n.k and e.s is not distinct from n.s)),
f as (select *, {similarity_sql('a', 'b')} as score from c), g as (select k, s, id, name, score from f where score >= 75 qualify row_number() over (partition by k, s order by score desc, id) = 1),
m as (select * from e union all select * from g)
select {_K}, r.district, r.state, m.id as district_id, coalesce(m.name, r.district) as district_name, m.score as district_score from r left join m on k = lower(trim(r.district)) and s is not distinct from nullif(r.state, '')""",
    "similarity_scores": f"""with n as (select distinct p_name as name from part), a(alias) as (values {', '.join(f'({_q(a)})' for a in L.CONTAMINANT_ALIASES)}),
c as (select name, alias, {_SORTED('name')} as x, {_SORTED('alias')} as y from n, a) select name, alias, round({similarity_sql('x', 'y')}, 6) as score from c""",
    "names_alike": f"""with x as (select distinct {_SORTED("p_name || ' ' || p_type")} as a from part), y as (select distinct {_SORTED('p_name')} as b from part),
c as (select a, b, {similarity_sql('a', 'b')} as s from x, y) select a, b, round(s, 6) as score from c where s >= 75""",
    "dates_loose": f"""with {RAW} select {_K}, case when line = 2 then strftime({_DAY}, '%Y-%m-01') when line <= 5 then day end as parsed, case when line = 2 then month({_DAY}) <> 5 when line <= 3 then true when line = 5 then day({_DAY}) <= 12 and day({_DAY}) <> month({_DAY}) else false end as ambiguous from raw""",
    "alias_dictionary": f"""with a(n, alias, canonical) as (values {', '.join(f'({n}, {_q(a)}, {_q(c)})' for n, (a, c) in enumerate([*L.CONTAMINANT_ALIASES.items(), *((x.lower(), n) for _, n, xs in CONTAMINANT_TABLE for x in (n, *xs))]))})
select alias, arg_max(canonical, n) as canonical from a group by alias""",
    "categories_by_table": f"""with {RAW}, r as (select {_K}, {_P(("Basmati Rice", "mystery", "Mandua", "unknown mix", "nothing", "Milk", ""))} as name from raw)
select {_K}, name, coalesce({_CATEGORY('name')}, case name when 'mystery' then 'packaged' when 'Mandua' then 'grain' when 'unknown mix' then 'packaged' end) as category from r""",
    "listing_links": """with p as (select page_id + 1 as n from pages where page_id < 7), l as (select n, 2 * n as k, 'Report Goa' as title from p union all select n, 2 * n + 1, 'Delhi report' from p union all select 1, 0, 'again')
select n::int as page_no, 'http://host/files/r' || k || '.PDF' as url, title, """
    + standard._chain([(f"contains(lower(title), {_q(a)})", _q(s)) for a, s in L.STATE_ALIASES.items()])
    + " as state from l",
    "feed_of_country": "with i as (select page_id, url || case when page_id % 3 = 0 then '/INDIA' else '' end as link, case when page_id % 5 = 0 then 'India' end as state from pages) select * from i where contains(lower(link), 'india') or state is not null",
    "landed_paths": f"""with f as (select page_id, coalesce(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/')[4:], lambda x: x <> '')[-1], 'report.pdf') as f from pages)
select page_id, 'raw/fssai/list/' || f as local, 'raw/fssai/list/{AS_OF.replace('-', '/')}/' || f as remote from f""",
    "entities_routed": "select n_nationkey, null::varchar as product, 'Acme' as brand, case when n_nationkey % 2 = 0 then n_name end as state, case when n_nationkey % 2 = 0 then 'Pune' end as district, '2024' as date from nation",
    "page_confidence": "select l_orderkey::varchar as source_url, 1 as page, string_agg('w' || l_partkey, ' ' order by l_linenumber, l_partkey, l_suppkey) as text, sum((l_quantity - 10)::decimal(9,4))::double / count(*) as conf from lineitem where l_quantity >= 10 group by l_orderkey",
    "pages_recognised": """select p_partkey::varchar as source_url, case when p_partkey % 4 = 0 then 'lead' when p_partkey % 10 = 7 then 'Cadmium' else 'Lead' end as contaminant, case when p_partkey % 4 = 0 then '1' when p_partkey % 10 = 7 then '9' else p_size::varchar end as value,
'ppb' as unit, case when p_partkey % 4 = 0 then 1.0 when p_partkey % 10 = 7 then 0.7 else 0.9 end::double as conf from part""",
    "facts_stored": f"with {ER} select order_id, commodity, contaminant_id::varchar as contaminant, ppb, test_date::varchar as test_date, amount from er where order_id % 9 > 0 and test_date >= date '2000-06-01'",
}


def _fuzzy_sql() -> str:
    """fuzzy_canonical by definition: exact aliases, else the most similar of 80 or more, the first of equals."""
    names = list(L.CONTAMINANT_ALIASES)
    listed = lambda v: "[" + ", ".join(map(_q, v)) + "]"
    spelt = [n[:4] + "x" + n[5:45] for n in names]
    title = [" ".join(w[:1].upper() + w[1:].lower() for w in n.split(" ")) for n in names]
    aliases = ", ".join(f"({n}, {_q(a)}, {_q(c)})" for n, (a, c) in enumerate(L.CONTAMINANT_ALIASES.items()))
    return f"""with {RAW}, r as (select {_K}, case when line % 2 = 0 then {listed(spelt)}[part_id % {len(names)} + 1] else {listed(title)}[part_id % {len(names)} + 1] end as name from raw), al(n, alias, canonical) as (values {aliases}),
k as (select distinct lower(trim(name)) as k from r), e as (select k, canonical, 100.0::double as score from k join al on k = alias),
c as (select k, n, canonical, {_SORTED('k')} as a, {_SORTED('alias')} as b from k, al where k not in (select k from e)), f as (select *, {similarity_sql('a', 'b')} as score from c),
m as (select * from e union all (select k, canonical, score from f where score >= 80 qualify row_number() over (partition by k order by score desc, n) = 1))
select {_K}, name, canonical, score from r left join m on k = lower(trim(name))"""


ORACLES["fuzzy_canonical"] = _fuzzy_sql()
