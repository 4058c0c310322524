import random

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S
from sparrowmill.operators import fuzzy, places
from sparrowmill.operators.similar import similar


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [67.0, 75.0, 80.0, 92.5, 100.0])
def test_no_similar_pair_is_missed(spark, least):
    rng = random.Random(int(least))
    texts = set()
    for size in (1, 2, 3, 4, 6, 9, 14, 25):
        for _ in range(9):
            word = [rng.choice("abcdé ") for _ in range(size)]
            texts.add("".join(word))
            for _ in range(rng.randrange(size) + 1):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "zz"])
            texts.add("".join(word))
    texts = sorted(texts)
    left, right = texts[::2] + texts[:20] + ["", None], texts[1::2] + texts[:20] + ["", None]
    got = similar(spark.createDataFrame([(t,) for t in left], "a string"), spark.createDataFrame([(t,) for t in right], "b string"), least)
    hand = {(a, b): 200 * common(a, b) / (len(a) + len(b)) for a in left if a for b in right if b}
    hand = {k: v for k, v in hand.items() if v >= least}
    found = {(r["a"], r["b"]): r["score"] for r in got.collect()}
    assert found.keys() == hand.keys() and all(abs(found[k] - v) < 1e-9 for k, v in hand.items())
    assert len(hand) >= 15


def test_thresholds_without_a_common_pair_are_refused(spark):
    one = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError):
        similar(one, one.withColumnRenamed("a", "b"), 60.0)
    assert similar(one.limit(0), one.withColumnRenamed("a", "b"), 80.0).count() == 0


def test_names_meet_no_nested_loop(spark):
    """Large dictionaries: every join has keys, whatever Spark broadcasts."""
    word = lambda seed: F.translate(F.substring(F.sha2((F.col("id") * 7 + seed).cast("string"), 256), 1, 12), "0123456789", "ghijklmnop")
    names = spark.range(400).select(F.concat(word(0), F.lit("x")).alias("district"), F.lit("").alias("state"))
    districts = spark.range(150).select(F.col("id").cast("int"), word(0).alias("name"), F.lit("Goa").alias("state"), F.lit(None).cast("array<string>").alias("alternate_names"))
    aliases = districts.select(F.col("id").alias("rank"), F.col("name").alias("alias"), F.col("name").alias("canonical"))
    for out in (places.resolve_districts(names, districts), fuzzy.canonicalise(names, "district", aliases, 80.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert out.count() == 400
        assert out.where("district_id is not null" if "district_id" in out.columns else "canonical is not null").count() == 150


def test_letter_pairs(spark):
    row = spark.range(1).select(S.sort_tokens(F.lit("b ab")).alias("t"))
    from sparrowmill.operators.similar import letter_pairs

    assert row.select(letter_pairs(F.lit("aaa"))).first()[0] == ["\x01a0", "aa0", "aa1", "a\x010"]
