import datetime

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + schema)
    return [r[0] for r in df.select(column.alias("v"), "n").orderBy("n").select("v").collect()]


def test_units(spark):
    rows = [("1,234", "ppb"), ("2", "ppm"), ("2", "MG/L"), ("5", "µg/kg"), ("5", "μg/kg"), ("0.5", "%"), ("4", "ng/kg"), ("4", "ppt"), ("3", "mg/kg dry"), ("2", "mg"), ("7", "kg"), ("7", "g"), ("7", ""), ("3", "mg / kg"), ("7", "furlong"), ("<0.5", "ppb"), ("abc", "ppb"), (None, "ppb")]
    want = [1234, 2000, 2000, 5, 5, 5000000, 0.004, 0.004, 3000, 2000, 7, 7, 7, None, None, None, None, None]
    assert values(spark, rows, "v string, u string", S.unit_to_ppb(F.col("v"), F.col("u"))) == want


def test_dates(spark):
    day = datetime.date
    rows = {
        "2024-03-05": (day(2024, 3, 5), False), "03/04/2024": (day(2024, 4, 3), True), "25/12/2023": (day(2023, 12, 25), False), "05/05/2024": (day(2024, 5, 5), False), "3-4-24": (day(2024, 4, 3), True),
        "01/02/99": (day(1999, 2, 1), True), "12 May 2024": (day(2024, 5, 12), False), "March 5, 2024": (day(2024, 3, 5), False), "05/2024": (day(2024, 5, 1), False), "March 2024": (day(2024, 3, 1), False),
        "31/02/2024": (None, False), "13/25/2024": (None, False), "": (None, False),
    }
    texts = [(t,) for t in rows]
    assert values(spark, texts, "d string", S.parse_date(F.col("d"))) == [v[0] for v in rows.values()]
    assert values(spark, texts, "d string", S.date_is_ambiguous(F.col("d"))) == [v[1] for v in rows.values()]


def test_dates_of_other_forms_are_ambiguous(spark):
    day = datetime.date
    rows = {"Mar 2024": (day(2024, 3, 1), True), "12-May-2024": (day(2024, 5, 12), True), "Tue, 05 Mar 2024 10:00:00 GMT": (day(2024, 3, 5), True), "5 Mar 2024 09:00:00 +0530": (day(2024, 3, 5), True), "25/12/2023": (day(2023, 12, 25), False), "03/04/2024": (day(2024, 4, 3), True), "nonsense": (None, False), None: (None, False)}
    got = values(spark, [(t,) for t in rows], "d string", S.parse_date_loosely(F.col("d")))
    assert [tuple(r) for r in got] == list(rows.values())


def test_verdicts_states_categories_addresses(spark):
    verdicts = {"Pass": True, "FAILED": False, "Compliant": True, "Satisfactory": True, "unsatisfactory": False, "non-conforming": False, "not safe": False, "Unsafe": False, "P": None, "Not detected": None, "": None, "Conforming under limit": False}
    assert values(spark, [(k,) for k in verdicts], "v string", S.normalise_pass_fail(F.col("v"))) == list(verdicts.values())
    states = {"MH": "Maharashtra", " orissa ": "Odisha", "NCT of Delhi": "Delhi", "ladakh": "Ladakh", "": None}
    assert values(spark, [(k,) for k in states], "v string", S.canonical_state(F.col("v"))) == list(states.values())
    foods = {"Basmati Rice": "grain", "groundnut oil": "produce", "mustard oil": "oil", "Fish curry": "seafood", "licorice": "grain", "mystery": None}
    assert values(spark, [(k,) for k in foods], "v string", S.commodity_category(F.col("v"))) == list(foods.values())
    mails = {"alice@x.com": "al***@x.com", "bob": "bo***@***", "a@b@c": "a***@b"}
    assert values(spark, [(k,) for k in mails], "v string", S.redact_email(F.col("v"))) == list(mails.values())


def test_digits_and_round_values(spark):
    digits = {45.2: 4, 0.052: 5, 0.000052: 5, 1240.0: 1, 0.0: None, -3.0: None, None: None}
    assert values(spark, [(k,) for k in digits], "v double", S.first_digit(F.col("v"))) == list(digits.values())
    round_ = {2.0: True, 1.5: True, 2.0005: True, 2.4995: True, 45.2: False, 3.1: False, None: None}
    assert values(spark, [(k,) for k in round_], "v double", S.is_round(F.col("v"))) == list(round_.values())


@pytest.mark.parametrize(("a", "b", "score"), [("b1 aflatoxn", "aflatoxin b1", 95.6522), ("b1 aflatoxin", "aflatoxin b1", 100.0), ("chlorpyriphos", "chlorpyrifos", 88.0), ("cadmum", "cadmium", 92.3077), ("leed", "lead", 75.0), ("bangalore", "bengaluru", 66.6667), ("", "x", 0.0)])
def test_similarity(spark, a, b, score):
    got = values(spark, [(a, b)], "a string, b string", S.similarity(S.sort_tokens(F.col("a")), S.sort_tokens(F.col("b"))))[0]
    assert got == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize(("tier", "inside", "ocr", "manual", "score"), [(False, False, 1.0, False, 0.7), (False, True, 1.0, False, 0.75), (True, False, 1.0, False, 0.8), (True, True, 0.79, False, 0.75), (True, True, 0.8, True, 1.0), (False, False, 0.5, False, 0.6)])
def test_confidence(spark, tier, inside, ocr, manual, score):
    got = values(spark, [(tier, inside, ocr, manual)], "t boolean, i boolean, o double, m boolean", S.confidence(*[F.col(c) for c in "tiom"]).cast("double"))
    assert got == [score]


def test_chi2_and_hash(spark):
    assert values(spark, [(15.507,)], "x double", S.chi2_survival_8(F.col("x")))[0] == pytest.approx(0.05, abs=1e-4)
    h = S.dedup_hash(F.lit("2024-01-01"), F.lit(""), F.lit(" Rice "), F.lit("lead"), F.lit(0.0), F.lit(None))
    assert len(values(spark, [(1,)], "x int", h)[0]) == 64


def test_aliases_are_whole():
    assert len(L.CONTAMINANT_ALIASES) == 20 and len(L.UNIT_TO_PPB) == 13 and len(L.STATE_ALIASES) == 64
