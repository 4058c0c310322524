"""A join of texts by similarity, over an inverted index of letter pairs.

The similarity is that of scalars.similarity: 200 times the longest common
subsequence over both lengths. Texts of lengths n and m that reach the threshold are at most D =
(n + m) * (1 - threshold / 100) single deletions and insertions apart. With a mark before
and after it, a text of n letters has n + 1 pairs of neighbouring letters; a deletion
spoils at most two of them and an insertion one, so both texts share at
least n + 1 - 2 x - y pairs (x letters deleted, y inserted, x + y <= D).

Hence the join: every text's pairs are put in one order, rare ones first; of so many first ones
that similar texts must share two of them, each two make a key of the index (each
one where the threshold ensures no more). Texts that meet under a key are checked by lengths, by
the letters and the pairs they share, and at last letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S
from sparrowmill.storage import written

#: At or below this a similar text may share no pair of letters.
LEAST = 200.0 / 3
_MARK = "\x01"


def letter_pairs(text: Column) -> Column:
    """The pairs of neighbouring letters, ends marked; of equal ones the second, third ... with its number."""
    marked = F.concat(F.lit(_MARK), text, F.lit(_MARK))
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(marked, i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)).cast("string")))


def letters(text: Column) -> Column:
    """The letters of a text; of equal ones the second, third ... with its number."""
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, F.lit(1), i), lambda x: x == c)).cast("string")))


def _apart(n: Column, m: Column, least: float) -> Column:
    """Most deletions and insertions between similar texts of these lengths (of the parity that the lengths demand), negative if none are similar."""
    most = F.floor((n + m) * (100.0 - least) / 100.0 + 1e-9).cast("int")
    return F.when(most < F.abs(n - m), F.lit(-1)).otherwise(most - F.pmod(most - F.abs(n - m), F.lit(2)))


def shared_pairs(n: Column, m: Column, least: float) -> Column:
    """How many letter pairs similar texts of these lengths share at least; null where the lengths alone exclude it."""
    d = _apart(n, m, least)
    gone, new = ((d - (m - n)) / 2).cast("int"), ((d + (m - n)) / 2).cast("int")
    return F.when(d >= 0, F.greatest(n + 1 - 2 * gone - new, m + 1 - 2 * new - gone))


def _least_shared(n: int, least: float) -> int:
    """shared_pairs of a text of n letters with its most different similar partner, for the driver."""
    out = n + 1
    for m in range(1, 4 * n + 4):
        d = int((n + m) * (100.0 - least) / 100.0 + 1e-9)
        if d >= abs(n - m):
            d -= (d - abs(n - m)) % 2
            gone, new = (d - (m - n)) // 2, (d + (m - n)) // 2
            out = min(out, max(n + 1 - 2 * gone - new, m + 1 - 2 * new - gone))
    return out


def _entered(n: Column, least: float, keys: int) -> Column:
    """How many of a text's pairs the index needs, so that similar texts share as many as make a key: all but those that even the least similar partner's share makes up for."""
    lo, hi = F.ceil(n * least / (200.0 - least) - 1e-9).cast("int"), F.floor(n * (200.0 - least) / least + 1e-9).cast("int")
    bounds = F.transform(F.sequence(F.greatest(lo, F.lit(1)), F.greatest(hi, lo, F.lit(1))), lambda m: shared_pairs(n, m, least))
    return n + 1 - F.coalesce(F.array_min(bounds), F.lit(1)) + keys


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score of all texts a of left (a) and b of right (b) with a similarity of at least least (0 to 100, over 66.7).

    Texts are compared as they are (see scalars.sort_tokens) and made distinct; null and empty ones match nothing.
    Cost grows with the texts and with what shares rare letter pairs, not with all pairs of texts.
    """
    if not LEAST < least <= 100:
        raise ValueError(f"a similarity from over {LEAST:.1f} to 100 is needed, not {least}")
    # Long texts share more than short ones, so short ones decide how many pairs make a key.
    together = 2 if min(_least_shared(n, least) for n in range(1, 64)) >= 2 else 1
    sides = {}
    for name, rows in (("a", left), ("b", right)):
        texts = rows.select(F.col(name).alias("text")).where("text <> ''").distinct()
        sides[name] = written(texts.select("text", F.length("text").alias("n"), letters(F.col("text")).alias("letters"), letter_pairs(F.col("text")).alias("pairs")), "texts")
    often = written(sides["b"].select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("often")), "often")
    entries = {}
    for name, texts in sides.items():
        each = texts.select("text", "n", F.explode("pairs").alias("pair")).join(often, "pair", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "pair")))
        ranked = each.groupBy("text", "n").agg(order.alias("order"))
        first = F.transform(F.slice("order", F.lit(1), _entered(F.col("n"), least, together).cast("int")), lambda x: x["pair"])
        both = lambda x, i, all_: F.transform(F.slice(all_, i + 2, F.size(all_)), lambda y: F.xxhash64(x, y))
        keys = ranked.select("text", "n", first.alias("first"))
        made = F.flatten(F.transform("first", lambda x, i: both(x, i, F.col("first")))) if together == 2 else F.transform("first", lambda x: F.xxhash64(x))
        entries[name] = keys.select(F.col("text").alias(name), F.col("n").alias(f"n_{name}"), F.explode(made).alias("key"))
    met = entries["a"].join(entries["b"], "key").where(_apart(F.col("n_a"), F.col("n_b"), least) >= 0).select("a", "b").distinct()
    for name, texts in sides.items():
        met = met.join(texts.select(F.col("text").alias(name), F.col("n").alias(f"n_{name}"), F.col("letters").alias(f"letters_{name}"), F.col("pairs").alias(f"pairs_{name}")), name)
    n, m = F.col("n_a"), F.col("n_b")
    likely = met.where(200.0 * F.size(F.array_intersect("letters_a", "letters_b")) >= least * (n + m) - 1e-9)
    likely = likely.where(F.size(F.array_intersect("pairs_a", "pairs_b")) >= shared_pairs(n, m, least)).select("a", "b")
    # Stored, as Spark would else compare letter by letter before it counts pairs; dealt over all tasks, as each row is dear.
    dealt = written(likely.repartition(int(likely.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "likely")
    return dealt.select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= least)
