import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S
from sparrowmill.operators.entities import Automaton, found_entities, leftmost
from sparrowmill.plans import runs, texts as plans_of_texts
from sparrowmill.sources import formats, grid


def found_by_hand(words, patterns):
    out, i = [], 0
    while i < len(words):
        best = max((p for p in patterns if tuple(words[i : i + len(p)]) == p), key=len, default=None)
        if best:
            out.append((i, len(best), patterns[best]))
        i += len(best) if best else 1
    return out


@pytest.mark.parametrize("seed", range(5))
def test_the_automaton_finds_the_leftmost_longest(seed):
    rng = random.Random(seed)
    patterns = {}
    for _ in range(30):
        patterns.setdefault(tuple(rng.choice("abc") for _ in range(rng.randrange(1, 6))), len(patterns))
    automaton = Automaton(list(patterns.items()))
    for _ in range(50):
        words = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        assert leftmost(automaton.longest(words)) == found_by_hand(words, patterns)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_entities_of_texts(spark, block):
    patterns = spark.createDataFrame(
        [("ORG", "Acme"), ("ORG", "Acme Foods Ltd."), ("GPE", "Tamil Nadu"), ("GPE", "tamil-nadu"), ("GPE", "Nadu"), ("PRODUCT", "Foods"), ("PRODUCT", "Ünder Öl"), ("X", "--"), ("X", None), ("GPE", "Goa")],
        "label string, text string",
    )
    texts = spark.createDataFrame([(1, "ACME foods ltd, acme foods; in Tamil Nadu (Goa)"), (2, None), (None, "under ünder öl Goan"), (3, "")], "id int, t string")
    got = {r["id"]: [(e["label"], e["text"], e["first"], e["words"]) for e in r["entities"]] for r in found_entities(texts, "id", "t", patterns, block).collect()}
    assert got == {1: [("ORG", "Acme Foods Ltd.", 0, 3), ("ORG", "Acme", 3, 1), ("PRODUCT", "Foods", 4, 1), ("GPE", "Tamil Nadu", 6, 2), ("GPE", "Goa", 8, 1)], 2: [], None: [("PRODUCT", "Ünder Öl", 1, 2)], 3: []}
    assert found_entities(texts, "id", "t", patterns.limit(0)).where("size(entities) > 0").count() == 0


DAY = datetime.date(2024, 3, 5)
LISTED = ["2024-03-05", "2024-3-5", "05/03/2024", "5/3/2024", "05-03-2024", "5-3-24", "05/03/24", "5 March 2024", "05 mar 2024", "March 5, 2024", "Mar 05, 2024", " 5  MARCH 2024 "]
LOOSE = [
    "5-Mar-2024", "05-March-2024", "2024/03/05", "05.03.2024", "Tue, 05 Mar 2024 10:20:30 GMT", "Tuesday, 5 March 2024", "5 Mar 2024 09:00", "March 5 2024", "5 March, 2024", "2024-03-05T10:00:00Z", "2024-03-05 10:00:00.123 +0530",
    "2024-03-05T10:00:00+05:30", "05/03/2024 10:20", "05/03/2024, 9:05 pm", "5th March 2024", "March 5th, 2024", "2024 Mar 5", "5/Mar/2024", "5 Mar 24", "Tue 5 Mar 2024 9:05 am IST",
]


def test_dates_of_listed_and_other_forms(spark):
    frame = spark.createDataFrame([(t,) for t in [*LISTED, *LOOSE]], "d string")
    got = frame.select("d", S.parse_date(F.col("d")).alias("strict"), S.parse_date_loosely(F.col("d")).alias("f")).collect()
    assert {r["d"] for r in got if r["f"]["day"] != DAY} == set()
    assert {r["d"] for r in got if r["strict"] == DAY} == set(LISTED)
    assert all(r["f"]["ambiguous"] for r in got if r["d"] in LOOSE)
    months = {"March 2024": False, "Mar 2024": True, "March, 2024": True, "03/2024": False, "2024 March": True, "may 2024": False}
    got = spark.createDataFrame([(t,) for t in months], "d string").select("d", S.parse_date_loosely(F.col("d")).alias("f")).collect()
    assert {r["d"]: r["f"]["ambiguous"] for r in got} == months and {r["f"]["day"].day for r in got} == {1}


def test_what_is_no_date(spark):
    bad = ["31/02/2024", "13/25/2024", "2024-13-01", "5 Foo 2024", "32 March 2024", "05/03/2024x", "5 March", "2024", "x", "", None, "1/2/3", "123/03/2024", "Foo 2024", "25:61", "29 Feb 2023", "99-99-99"]
    got = spark.createDataFrame([(t,) for t in bad], "d string").select(S.parse_date_loosely(F.col("d")).alias("f")).collect()
    assert [r["f"]["day"] for r in got] == [None] * len(bad)
    edge = {"01/02/68": datetime.date(2068, 2, 1), "01/02/69": datetime.date(1969, 2, 1), "29-02-24": datetime.date(2024, 2, 29)}
    got = spark.createDataFrame([(t,) for t in edge], "d string").select("d", S.parse_date(F.col("d")).alias("x")).collect()
    assert {r["d"]: r["x"] for r in got} == edge


def test_fields_of_sentences(spark):
    texts = {
        "Aflatoxin G2 at 3 ppb in Mar 2024": ("Aflatoxin G2", "3", "ppb", "Mar 2024"), "AFLATOXIN-M1 on January, 2024": ("AFLATOXIN", None, None, "January, 2024"), "e.coli 2024/05/12 1.5%": ("e.coli", "1.5", "%", "2024/05/12"),
        "ochratoxin a, Heavy metal; 12/5/24": ("ochratoxin a", None, None, "12/5/24"), "nothing": (None, None, None, None), "12 May 2024: E. coli": ("E. coli", None, None, "May 2024"),
    }
    got = formats.text_fields(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    said = {r["text"]: (r["contaminant"], r["value"], r["unit"], r["date"]) for r in got}
    assert said == texts


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_shuffled_for_their_names(spark, small):
    """Names that were found are few and stored, so rows meet them by broadcast; sizes that Spark doesn't know would shuffle all rows by a few hot names."""
    plan = planned(runs.standardised_records(spark, small))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_a_date_is_taken_apart_once(spark):
    """However often day and ambiguity are read: the look-up by shape stands once in the plan, once more for bare texts."""
    read = spark.createDataFrame([("5 May 2020",)], "d string").select(S.parse_date_loosely(F.col("d")).alias("f")).select("f.day", "f.ambiguous", F.col("f.day").isNull().alias("none"))
    assert planned(read).count("[a-z]+") <= 2


def test_a_whole_ingest_shuffles_no_rows(spark, small):
    plan = planned(plans_of_texts.ingest_resolved(spark, small))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_tables_of_words_over_many_batches(spark):
    """Pages that end and go on across Arrow batches, ties in place, overlapping words: the same in one batch and in many, together and shuffled, and by hand."""
    dice = random.Random(5)
    words = [(f"u{p // 7}" if p % 7 else None, p % 3, x, x + dice.randint(0, 40), y, y + dice.randint(1, 12), dice.choice("abcé𝄞"))
             for p in range(60) for _ in range(dice.choice((0, 1, 5, 40, 300))) for x, y in [(dice.randint(0, 30) * 10.0, dice.randint(0, 60) * 8.0)]]
    names = ["source_url", "page", "x0", "x1", "y0", "y1", "word"]
    frame = spark.createDataFrame([(*w[:2], *map(float, w[2:6]), w[6]) for w in words], "source_url string, page int, x0 double, x1 double, y0 double, y1 double, word string")
    by_page = {}
    for w in words:
        by_page.setdefault(w[:2], []).append(dict(zip(names, w)))
    expected = {(*p, n): rows for p, some in by_page.items() for n, rows in enumerate(tables_by_hand(some, 8.0), 1)}
    read = lambda f: {(r["source_url"], r["page"], r["table_no"]): r["rows"] for r in f.collect()}
    assert len(expected) > 20 and read(grid.tables_of_words(frame, 8.0)) == expected
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(key, "13")
        assert read(grid.tables_of_words(frame.coalesce(1).sortWithinPartitions("source_url", "page"), 8.0, together=True)) == expected
    finally:
        spark.conf.set(key, before)


def islands_by_hand(rows, lo, hi, gap, *order):
    out, reach = [], None
    for r in sorted(rows, key=lambda r: tuple(r[k] for k in order)):
        if reach is None or r[lo] >= reach + gap:
            out.append([])
        out[-1].append(r)
        reach = r[hi] if reach is None else max(reach, r[hi])
    return out


def tables_by_hand(words, gap):
    tables, open_ = [], False
    for n, line in enumerate(islands_by_hand(words, "y0", "y1", 0.0, "y0", "y1", "x0", "word")):
        tabular = len(islands_by_hand(line, "x0", "x1", gap, "x0", "x1", "word")) > 1
        if tabular and not open_:
            tables.append([])
        if tabular:
            tables[-1] += [w | {"line": n} for w in line]
        open_ = tabular
    out = []
    for table in tables:
        cells = islands_by_hand(table, "x0", "x1", gap, "x0", "x1", "line", "word")
        text = lambda cell, n: " ".join(w["word"] for w in sorted((w for w in cell if w["line"] == n), key=lambda w: (w["x0"], w["y0"], w["word"])))
        out.append([[text(c, n) for c in cells] for n in sorted({w["line"] for w in table})])
    return out


def test_lines_not_words_are_shuffled_for_tables(spark, small):
    """One shuffle, of what lines are made of, where words were shuffled and sorted time and again."""
    plan = planned(plans_of_texts.grid_tables(spark, small))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Join" not in plan


def test_patterns_by_first_letter_find_the_same(spark):
    """Against the alternatives joined by |, in texts with letters that fold to others and alternatives that are parts of others."""
    dice = random.Random(9)
    words = ["kerala", "Kerala", "punjab", "pun", "Sikkim", "ſikkim", "Ikon", "ıkon", "İkon", "goa", "GOAT", "x", "é", "1", "pun jab"]
    frame = spark.createDataFrame([("".join(dice.choice(words) + dice.choice(["", " ", "-", "é"]) for _ in range(dice.randint(0, 6))),) for _ in range(800)], "t string")
    listed = ["pun", "Punjab", "kerala", "Sikkim", "ikon", r"goat?", "kera"]
    for before, after in (("", ""), (r"\b", r"\b")):
        plain, grouped = rf"(?iu){before}({'|'.join(listed)}){after}", "(?iu)" + S.by_first_letter(listed, before) + after
        got = frame.select("t", *[F.regexp_extract_all("t", F.lit(p), F.lit(1)).alias(n) for n, p in (("a", plain), ("b", grouped))]).collect()
        assert sum(len(r["a"]) for r in got) > 500 and [r["a"] for r in got] == [r["b"] for r in got]


def test_a_value_and_its_unit_are_found_once(spark):
    texts = spark.createDataFrame([("1.5% of 20 ppb",), ("12.5 µG/KG",), ("3.ppm 4\tng/g",), ("7 of 8",), (None,)], "text string")
    found = formats.text_fields(texts, "text")
    assert planned(found.select("value", "unit")).count("ppt") == 1
    assert [(r["value"], r["unit"]) for r in found.collect()] == [("1.5", "%"), ("12.5", "µG/KG"), ("4", "ng/g"), (None, None), (None, None)]
