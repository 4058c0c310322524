"""From raw fields to scored facts: the stages of an ingest run, each a DataFrame in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S
from sparrowmill.operators import fuzzy, places
from sparrowmill.storage import drop_written, written

RAW = ("product_name", "contaminant", "value", "unit", "date", "state", "district", "lab", "pass_fail")


def standardise(rows: DataFrame, aliases: DataFrame, limits: DataFrame, keep: list[str], districts: DataFrame | None = None) -> DataFrame:
    """keep and the standard fields of rows, which have the columns RAW as text.

    aliases: rank, alias, canonical (see places.alias_dictionary). limits: contaminant, limit_ppb. districts: see
    places.resolve_districts; without it districts are only trimmed. Dates in no listed format are read loosely and
    count as ambiguous. Fields that can't be read are null and named in errors; a district that isn't found keeps its text.
    """
    known = fuzzy.canonicalise(rows, "contaminant", aliases, 80.0, limits.select(F.col("contaminant").alias("canonical"), "limit_ppb"))
    ppb, day = S.unit_to_ppb(F.col("value"), F.col("unit")), S.parse_date_loosely(F.col("date"))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    read = known.withColumns({"_ppb": ppb, "_day": day, "_state": S.canonical_state(F.col("state"))})
    errors = F.array_compact(
        F.array(
            F.when(filled(F.col("contaminant")) & F.col("canonical").isNull(), F.lit("contaminant")),
            F.when(filled(F.col("value")) & F.col("_ppb").isNull(), F.lit("unit")),
            F.when(filled(F.col("date")) & F.col("_day.day").isNull(), F.lit("date")),
        )
    )
    out = read.select(
        *keep, F.lower(F.trim("product_name")).alias("commodity"), F.col("canonical").alias("contaminant"), F.col("score").alias("match_score"), F.col("_ppb").alias("ppb"), "limit_ppb",
        S.infer_pass_fail(S.normalise_pass_fail(F.col("pass_fail")), F.col("_ppb"), F.col("limit_ppb")).alias("pass_fail"), F.col("_day.day").alias("test_date"), F.col("_day.ambiguous").alias("date_ambiguous"),
        F.col("_state").alias("state"), F.trim("district").alias("district"), F.trim("lab").alias("lab"), errors.alias("errors"),
    )
    if districts is None:
        return out
    found = places.resolve_districts(out, districts)
    return found.select(*[F.col("district_name").alias("district") if c == "district" else c for c in out.columns], "district_id")


def flag_duplicates(rows: DataFrame, history: DataFrame, order: list[str]) -> DataFrame:
    """rows with hash and is_duplicate: in history (a column hash) or seen before in the order given."""
    h = S.dedup_hash(F.col("test_date"), F.col("lab"), F.col("commodity"), F.col("contaminant"), F.col("ppb"), F.col("district"))
    hashed = rows.withColumn("hash", h)
    seen = history.select("hash").distinct().withColumn("_seen", F.lit(True))
    first = Window.partitionBy("hash").orderBy(*order)
    flagged = hashed.join(seen, "hash", "left").withColumn("is_duplicate", F.col("_seen").isNotNull() | (F.row_number().over(first) > 1))
    return flagged.drop("_seen")


def lab_tiers(names: DataFrame, labs: DataFrame | None) -> DataFrame:
    """name, tier of each different name: 1 by a keyword in it, else the tier of the laboratory (lab_id, lab_name, tier) with the lowest id whose name contains it."""
    distinct = names.select("name").where(F.trim("name") != "").distinct()
    if labs is None:
        return distinct.select("name", S.lab_tier(F.col("name")).alias("tier"))
    distinct = written(distinct, "labs").withColumn("_word", S.lab_tier(F.col("name")))
    found = labs_by_name(distinct.where("_word is null"), labs).join(labs.select("lab_id", F.col("tier").alias("_table")), "lab_id").select(F.col("name").alias("_n"), "_table")
    return distinct.join(found, F.col("name") == F.col("_n"), "left").select("name", F.coalesce("_word", "_table").alias("tier"))


def score(rows: DataFrame, ocr: Column, manual: Column, commodities: DataFrame | None = None, labs: DataFrame | None = None) -> DataFrame:
    """rows with category, confidence, breakdown (what each part adds) and is_usable; the ranges are a dozen rows.

    commodities (id, name, category, aliases) and labs (lab_id, lab_name, tier) are asked where words in a name decide nothing.
    """
    spark = rows.sparkSession
    ranges = spark.createDataFrame([(c, g, lo, hi) for (c, g), (lo, hi) in L.TYPICAL_RANGES.items()], "contaminant string, category string, lo double, hi double")
    if commodities is None:
        named = rows.withColumn("category", S.commodity_category(F.col("commodity")))
    else:
        goods = written(rows.select(F.col("commodity").alias("name")).distinct(), "names")
        found = written(places.categories_by_table(goods, commodities), "categories")
        named = rows.join(found.withColumnRenamed("name", "commodity"), "commodity", "left").select(*rows.columns, "category")
    # What is found for names is stored, so that Spark knows its size and needn't shuffle rows by a few hot names.
    tiers = written(lab_tiers(rows.select(F.col("lab").alias("name")), labs), "tiers")
    known = named.join(F.broadcast(ranges), ["contaminant", "category"], "left").join(tiers.select(F.col("name").alias("_lab"), "tier"), F.col("lab") == F.col("_lab"), "left")
    inside = F.coalesce(F.col("ppb").between(F.col("lo"), F.col("hi")), F.lit(False))
    parts = (F.coalesce(F.col("tier") == 1, F.lit(False)), inside, ocr, manual)
    value = S.confidence(*parts)
    out = known.withColumn("confidence", value).withColumn("breakdown", S.confidence_parts(*parts)).withColumn("is_usable", value >= L.USABLE)
    return out.select(*rows.columns, "category", "confidence", "breakdown", "is_usable")


def append_facts(rows: DataFrame, path: str, as_of: str) -> tuple[int, int]:
    """Append rows with commodity, contaminant and value to the table at path, by year; the rest is skipped. Returns both counts.

    A missing date is as_of. One job writes all, so a failed run leaves nothing. The batch is stored first: it is
    computed once, and counting reads one column of it. (Metrics that Spark observes on the way would do, but a session that
    has observed any can't run Spark's forests any more.)
    """
    ready = rows.withColumn("test_date", F.coalesce("test_date", F.lit(as_of).cast("date"))).withColumn("test_year", F.year("test_date"))
    good = F.col("commodity").isNotNull() & F.col("contaminant").isNotNull() & F.col("ppb").isNotNull()
    stored = written(ready.withColumn("_good", good), "batch")
    counts = stored.agg(F.count_if("_good").alias("kept"), F.count_if(~F.col("_good")).alias("skipped")).first()
    stored.where("_good").drop("_good").write.mode("append").partitionBy("test_year").parquet(path)
    drop_written(stored)
    return counts["kept"], counts["skipped"]


def facts_since(table: DataFrame, day: str) -> DataFrame:
    """Rows from day on of a table stored by append_facts; the year's own condition prunes folders."""
    return table.where((F.col("test_year") >= int(day[:4])) & (F.col("test_date") >= F.lit(day).cast("date")))


def labs_by_name(names: DataFrame, labs: DataFrame) -> DataFrame:
    """name, lab_id: the lowest id among laboratories whose name contains the text, in either case.

    Distinct names meet the dimension of laboratories, not facts.
    """
    distinct = names.select("name").where(F.trim("name") != "").distinct()
    return distinct.join(labs, F.lower("lab_name").contains(F.lower(F.trim("name")))).groupBy("name").agg(F.min("lab_id").alias("lab_id"))
