"""Districts by name: exact within the state, else the most similar one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S
from sparrowmill.operators.similar import similar
from sparrowmill.storage import written


def resolve_districts(rows: DataFrame, districts: DataFrame, least: float = 75.0) -> DataFrame:
    """rows (with district and state) with district_id, district_name and district_score.

    districts: id, name, state, alternate_names. Names and alternates, trimmed and
    lower-cased, match exactly first (score 100; of several the highest id), then
    by token-sorted similarity of at least least (the highest, then the lowest id),
    each within the row's state where it has one. Names that match nothing keep their
    text and get no id. Distinct names meet the dimension of districts, not facts,
    over an index of letter pairs (see similar); they and what is found are stored (see fuzzy.canonicalise).
    """
    key, state = F.lower(F.trim("district")), F.trim("state")
    variants = districts.select("id", F.col("name").alias("_name"), F.col("state").alias("_in"), F.explode(F.concat(F.array("name"), F.coalesce("alternate_names", F.expr("cast(array() as array<string>)")))).alias("_variant"))
    variants = variants.select("id", "_name", "_in", F.lower(F.trim("_variant")).alias("_variant")).where("_variant <> ''")
    names = written(rows.select(key.alias("_key"), F.nullif(state, F.lit("")).alias("_state")).where("_key <> ''").distinct(), "places")
    here = F.col("_state").isNull() | (F.col("_state") == F.col("_in"))
    exact = names.join(variants, (F.col("_key") == F.col("_variant")) & here).groupBy("_key", "_state").agg(F.max(F.struct("id", "_name")).alias("b"))
    exact = exact.select("_key", "_state", "b.id", F.col("b._name").alias("_name"), F.lit(100.0).alias("score"))
    known = exact.select(F.col("_key").alias("k"), F.col("_state").alias("s"))
    rest = names.join(known, (F.col("_key") == F.col("k")) & F.col("_state").eqNullSafe(F.col("s")), "left_anti").withColumn("_sorted", S.sort_tokens(F.col("_key")))
    ready = variants.withColumn("_alias", S.sort_tokens(F.col("_variant")))
    pairs = similar(rest.select(F.col("_sorted").alias("a")), ready.select(F.col("_alias").alias("b")), least)
    met = rest.join(pairs, F.col("_sorted") == F.col("a")).join(ready, (F.col("b") == F.col("_alias")) & here)
    scored = met.select("_key", "_state", "id", "_name", "score")
    best = scored.groupBy("_key", "_state").agg(F.max(F.struct("score", (-F.col("id")).alias("r"), "id", "_name")).alias("b"))
    found = exact.unionByName(best.select("_key", "_state", "b.id", "b._name", "b.score"))
    found = written(found.select(F.col("_key").alias("k"), F.col("_state").alias("s"), F.col("id").alias("district_id"), F.col("_name").alias("_found"), F.col("score").alias("district_score")), "places")
    joined = rows.withColumn("_key", key).withColumn("_state", F.nullif(state, F.lit(""))).join(found, (F.col("_key") == F.col("k")) & F.col("_state").eqNullSafe(F.col("s")), "left")
    return joined.select(*rows.columns, "district_id", F.coalesce("_found", "district").alias("district_name"), "district_score")


def alias_dictionary(fixed: DataFrame, table: DataFrame) -> DataFrame:
    """rank, alias, canonical: fixed aliases (rank, alias, canonical), canonical names of the table (id, name, aliases) and its aliases; later ones overwrite.

    rank is a struct by which aliases stand in the order of their first entry.
    """
    own = F.array(F.struct(F.lit(0).alias("n"), F.col("name").alias("alias")))
    more = F.transform(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), lambda a, n: F.struct((n + 1).alias("n"), a.alias("alias")))
    rows = table.select("id", F.col("name").alias("canonical"), F.explode(F.concat(own, more)).alias("a"))
    late = rows.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("major"), F.col("a.n").alias("minor"), F.lower("a.alias").alias("alias"), "canonical")
    early = fixed.select(F.lit(0).alias("part"), F.col("rank").cast("long").alias("major"), F.lit(0).alias("minor"), F.lower("alias").alias("alias"), "canonical")
    place = F.struct("part", "major", "minor")
    named = early.unionByName(late).groupBy("alias").agg(F.min(place).alias("rank"), F.max_by("canonical", place).alias("canonical"))
    return named.select("rank", "alias", "canonical")


def categories_by_table(names: DataFrame, commodities: DataFrame) -> DataFrame:
    """names (name) with category: by words in the name, else of the commodity (id, name, category, aliases) with the lowest id whose name contains it or that has it as an alias."""
    distinct = written(names.select("name").where(F.trim("name") != "").distinct(), "names").withColumn("_word", S.commodity_category(F.col("name")))
    open_ = distinct.where("_word is null").select(F.col("name").alias("_n"))
    hit = F.ilike("c.name", F.concat(F.lit("%"), F.lower(F.trim("_n")), F.lit("%"))) | F.array_contains("c.aliases", F.col("_n"))
    found = open_.join(commodities.alias("c"), hit).groupBy("_n").agg(F.min(F.struct("c.id", "c.category")).alias("b")).select("_n", F.col("b.category").alias("_table"))
    known = written(distinct.select("name", "_word").join(found, F.col("name") == F.col("_n"), "left").select("name", F.coalesce("_word", "_table").alias("category")), "categories")
    return names.join(known, "name", "left")
