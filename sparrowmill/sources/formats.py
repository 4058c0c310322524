"""Raw inputs as DataFrames: HTML links, feeds, market figures, tables of documents, scanned pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S


def html_links(pages: DataFrame, extension: str = ".pdf") -> DataFrame:
    """page_id, url, title, state of each anchor whose address ends so (in either case), without its own page's repeats.

    Relative addresses are resolved against the page; the title is the anchor's text, else its title attribute, else the file's stem.
    """
    anchor = r"(?is)<a\s([^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*)>(.*?)</a>"
    found = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(anchor), F.lit(n)).alias(name) for n, name in ((1, "tag"), (2, "href"), (3, "inner"))])
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(found).alias("a"))
    href = F.col("a.href")
    rows = rows.where(F.lower(href).endswith(extension.lower()))
    root, folder = F.regexp_extract("base", r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract("base", r"^([a-z]+://[^?#]*/)", 1)
    url = F.when(href.rlike("^[a-zA-Z]+://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))
    text = F.trim(F.regexp_replace("a.inner", "<[^>]*>", ""))
    stem = F.regexp_extract(href, r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = F.trim(F.regexp_extract("a.tag", r"(?is)\btitle\s*=\s*[\"']([^\"']*)[\"']", 1))
    title = F.coalesce(F.nullif(text, F.lit("")), F.nullif(named, F.lit("")), stem)
    return rows.select("page_id", url.alias("url"), title.alias("title"), S.state_in_title(title).alias("state")).dropDuplicates(["page_id", "url"])


def feed_items(feeds: DataFrame) -> DataFrame:
    """From feed_url and xml: link, product, contaminant, date of each item; broken feeds give none. The verdict is always a failure."""
    item = "struct<title:string,description:string,pubDate:string,link:string>"
    parsed = F.from_xml("xml", f"channel struct<item:array<{item}>>", {"mode": "PERMISSIVE"})
    rows = feeds.select("feed_url", F.explode(parsed["channel"]["item"]).alias("i"))
    part = lambda n: F.nullif(F.trim(F.get(F.split(F.col("i.title"), "-"), n)), F.lit(""))
    clean = lambda name: F.nullif(F.trim(F.col(f"i.{name}")), F.lit(""))
    return rows.select(F.coalesce(clean("link"), F.col("feed_url")).alias("link"), part(1).alias("product"), part(2).alias("contaminant"), clean("pubDate").alias("date"), F.lit("fail").alias("pass_fail"))


def market_records(texts: DataFrame) -> DataFrame:
    """From source_url and json (a list, or an object with records): product, date, state, district, value.

    Each is looked for under its spellings; empty text and the number 0 count as missing.
    """
    kind = "array<map<string,string>>"
    records = F.coalesce(F.from_json("json", kind), F.from_json(F.get_json_object("json", "$.records"), kind))
    rows = texts.select("source_url", F.explode(records).alias("r"))
    value = lambda name: F.when(~F.col("r")[name].isin("", "0", "0.0", "false", "null"), F.nullif(F.trim(F.col("r")[name]), F.lit("")))
    either = lambda *names: F.coalesce(*[value(n) for n in names])
    return rows.select("source_url", either("commodity", "Commodity").alias("product"), either("arrivals_date", "date").alias("date"), either("state", "State").alias("state"), either("district", "District").alias("district"), either("min_price", "modal_price").alias("value"))


def _column(header: Column, words: tuple[str, ...]) -> Column:
    """The index of the first column that holds the first word that any column holds."""
    return F.coalesce(*[F.nullif(_position(header, w), F.lit(0)) for w in words])


def _position(header: Column, word: str) -> Column:
    return F.array_position(F.transform(header, lambda h: h.contains(word)), True)


def table_records(tables: DataFrame) -> DataFrame:
    """From source_url and rows (array of arrays of text, the first a header): a record for each row that isn't blank.

    Tables of fewer than two rows give none; short rows have nulls at their end.
    """
    header = F.transform(F.element_at("rows", 1), lambda h: F.lower(F.trim(F.coalesce(h, F.lit("")))))
    keyed = tables.where(F.size("rows") >= 2).select("source_url", "rows", *[_column(header, words).alias(f"_{name}") for name, words in L.HEADER_WORDS.items()])
    body = F.slice("rows", F.lit(2), F.size("rows") - 1)
    each = keyed.select("source_url", *[f"_{n}" for n in L.HEADER_WORDS], F.posexplode(body).alias("row_no", "cells"))
    each = each.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    cell = lambda name: F.nullif(F.trim(F.get("cells", F.col(f"_{name}") - 1)), F.lit(""))
    return each.select("source_url", "row_no", *[cell(n).alias(n) for n in L.HEADER_WORDS])


def text_fields(texts: DataFrame, column: str) -> DataFrame:
    """texts with the first contaminant, value, unit, verdict, date, state and laboratory found in a column of running text."""
    patterns = S.field_patterns()
    find = lambda name, group=1: F.nullif(F.regexp_extract(column, "(?iu)" + patterns[name], group), F.lit(""))
    # A value and its unit are found once; digits end where the unit or white space begins.
    placed = texts.withColumn("_measured", find("value_unit", 0))
    number = r"^\d+(?:\.\d+)?"
    return placed.select(
        *texts.columns, find("contaminant").alias("contaminant"), F.regexp_substr("_measured", F.lit(number)).alias("value"), F.regexp_replace("_measured", rf"{number}\s*", "").alias("unit"), find("pass_fail").alias("verdict"),
        find("date").alias("date"), find("state").alias("state"), find("lab_id").alias("lab_id"),
    )


def routed_entities(texts: DataFrame, entities: str) -> DataFrame:
    """texts with product, brand, state, district and date from a column of named entities, array<struct<label,text>> of a model outside Spark.

    The first PRODUCT, ORG and DATE count; of places (GPE) the first is the state, the second the district.
    """
    nth = lambda label, n=0: F.get(F.transform(F.filter(entities, lambda e: e["label"] == label), lambda e: e["text"]), n)
    return texts.select("*", nth("PRODUCT").alias("product"), nth("ORG").alias("brand"), nth("GPE").alias("state"), nth("GPE", 1).alias("district"), nth("DATE").alias("date"))


def mean_confidence(words: DataFrame) -> DataFrame:
    """source_url, page, text and conf of read words (source_url, page, position, word, conf): conf is the mean of those not below 0, which alone count."""
    read = words.where(F.col("conf") >= 0).groupBy("source_url", "page")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda w: w["word"]), " ")
    return read.agg(joined.alias("text"), (F.sum(F.col("conf").cast("decimal(9,4)")).cast("double") / F.count(F.lit(1))).alias("conf"))


def listed_links(pages: DataFrame, extension: str = ".pdf") -> DataFrame:
    """page_no, url, title, state of the links of a listing (page_no, url, html), each address at its first page only.

    The listing ends before the first page without a link that no earlier page has, or
    that is missing: later pages count for nothing.
    """
    links = html_links(pages.select(F.col("page_no").alias("page_id"), "url", "html"), extension).withColumnRenamed("page_id", "page_no")
    first = links.groupBy("url").agg(F.min(F.struct("page_no", "title", "state")).alias("f")).select("f.page_no", "url", "f.title", "f.state")
    with_new = first.select("page_no").distinct()
    # pages 1 to n all have new links if and only if the n-th such page has the number n: the first gap ends the listing
    numbered = with_new.withColumn("n", F.row_number().over(Window.orderBy("page_no"))).where("page_no = n").select("page_no")
    return first.join(numbered, "page_no", "left_semi")


def of_country(items: DataFrame, country: str = "india") -> DataFrame:
    """Those feed items whose link or state names the country, in either case."""
    names = lambda c: F.coalesce(F.lower(F.col(c).cast("string")).contains(country), F.lit(False))
    return items.where(names("link") | (names("state") if "state" in items.columns else F.lit(False)))


def landed_path(source: Column, page_type: Column, url: Column, day: Column | None = None) -> Column:
    """Where a downloaded file belongs: raw/source/page_type[/yyyy/MM/dd]/file, the file named by its address."""
    stem = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)", 1)
    parts = [F.lit("raw"), source, page_type, *([F.date_format(day, "yyyy/MM/dd")] if day is not None else []), F.coalesce(F.nullif(stem, F.lit("")), F.lit("report.pdf"))]
    return F.concat_ws("/", *parts)


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Landed files as rows: path, source, page_type, size and content, read as needed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/raw")
    place = F.split(F.regexp_extract("path", r"/raw/(.*)$", 1), "/")
    return files.select("path", F.get(place, 0).alias("source"), F.get(place, 1).alias("page_type"), F.col("length").alias("size"), "content")


def recognised(pages: DataFrame, primary: Callable[[bytes], tuple[str, float]], fallback: Callable[[bytes], tuple[str, float]]) -> DataFrame:
    """source_url, page, text, conf: the primary reader's text, or the fallback's where the first is less sure than OCR_LEAST.

    The readers are models outside Spark, called once a page in Arrow batches; pages without text drop out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [primary(x) for x in batch["image"]]
            out = [fallback(x) if conf < L.OCR_LEAST else (text, conf) for x, (text, conf) in zip(batch["image"], out)]
            yield batch[["source_url", "page"]].assign(text=[t for t, _ in out], conf=[c for _, c in out])

    return pages.select("source_url", "page", "image").mapInPandas(read, "source_url string, page int, text string, conf double").where(F.trim("text") != "")


def documents_or_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of tables, and for documents without any the fields of their pages that have a contaminant or value."""
    rest = text_fields(pages.join(records.select("source_url").distinct(), "source_url", "left_anti"), "text").where("contaminant is not null or value is not null")
    names = ["source_url", "contaminant", "value", "unit", "date", "state", "lab_id"]
    return records.select(*names, F.lit(1.0).alias("conf")).unionByName(rest.select(*names, "conf"))
