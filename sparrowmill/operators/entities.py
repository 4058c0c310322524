"""Named entities found in running text by an automaton of many patterns.

Texts and patterns are read as words (runs of letters and digits, lower-cased). The
patterns form a trie of words with a failure link from each state to the state of its
longest proper suffix, so one pass over a text finds all patterns, however many. Of
overlapping ones the leftmost counts, of those that start alike the longest.

The dictionary is dealt into blocks of a bounded size by the pattern's first word. Each
block's automaton goes to the executors and reports the longest pattern at each place; all
blocks' reports of a text are then resolved together, so the blocks don't show.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton.
BLOCK = 8 << 20
_WORD = re.compile(r"[^\W_]+")
#: The same for Spark.
WORD = r"[\p{L}\p{N}]+"


class Automaton:
    """Patterns as tuples of words, each with a number."""

    def __init__(self, patterns: list[tuple[tuple[str, ...], int]]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.depth, self.hit = [0], [0], [-1]
        for words, number in patterns:
            state = 0
            for w in words:
                if w not in self.next[state]:
                    self.next[state][w] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.depth.append(self.depth[state] + 1)
                    self.hit.append(-1)
                state = self.next[state][w]
            self.hit[state] = number
        #: The longest shorter pattern that ends where a state does.
        self.also = [0] * len(self.next)
        line = list(self.next[0].values())
        for state in line:
            for w, child in self.next[state].items():
                back = self.fail[state]
                while back and w not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(w, 0)
                line.append(child)
            back = self.fail[state]
            self.also[state] = back if self.hit[back] >= 0 else self.also[back]

    def longest(self, words: list[str]) -> list[tuple[int, int, int]]:
        """first word, words, number of the longest pattern that starts at each word where one does, in order."""
        best: dict[int, tuple[int, int]] = {}
        state = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(w, 0)
            at = state if self.hit[state] >= 0 else self.also[state]
            while at:
                best[k + 1 - self.depth[at]] = self.depth[at], self.hit[at]  # later ends are longer
                at = self.also[at]
        return [(first, *best[first]) for first in sorted(best)]


def leftmost(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of matches in order of their first word, those that don't begin inside one that is kept."""
    out, free = [], 0
    for m in found:
        if m[0] >= free:
            out.append(m)
            free = m[0] + m[1]
    return out


def dictionary_blocks(patterns: DataFrame, block: int = BLOCK) -> list[tuple[Automaton, list[tuple[str, str]]]]:
    """Automata over patterns (label, text) of at most about block bytes each, with the (label, text) of each number.

    Patterns that read alike are one: the least label and text. Those without a word drop out.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"))
    own = patterns.select("label", "text", words.alias("words")).where(F.size("words") > 0)
    own = own.groupBy("words").agg(F.min(F.struct("label", "text")).alias("p"))
    size = own.agg(F.coalesce(F.sum(F.length("p.text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block))
    out = []
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64(F.get("words", F.lit(0))), F.lit(n)) == k).select("words", "p.label", "p.text").collect()
        out.append((Automaton([(tuple(r["words"]), i) for i, r in enumerate(rows)]), [(r["label"], r["text"]) for r in rows]))
    return out


def found_entities(texts: DataFrame, key: str, column: str, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """texts with entities: array<struct<label, text, first, words>> in order of place, of a column of running text.

    key: a column that tells rows apart. patterns: label, text. first is the number of the entity's first word (from 0), words
    how many it has. Null texts have none.
    """
    blocks = dictionary_blocks(patterns, block)
    struct = "label string, text string, first int, words int"
    kind = pa.list_(pa.struct([("label", pa.string()), ("text", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch], held: tuple, resolve: bool) -> Iterator[pa.RecordBatch]:
        automaton, names = held
        for batch in batches:
            out = []
            for text in batch.column("t").to_pylist():
                hits = automaton.longest(_WORD.findall(text.lower()) if text else [])
                out.append([{"label": names[i][0], "text": names[i][1], "first": at, "words": n} for at, n, i in (leftmost(hits) if resolve else hits)])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, kind)], ["k", "entities"])

    rows = texts.select(F.col(key).alias("k"), F.col(column).cast("string").alias("t"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, entities array<struct<{struct.replace(' ', ':').replace(',:', ',')}>>"
    alone = len(blocks) == 1
    reports = [rows.mapInArrow(lambda b, held=held: scan(b, held, alone), schema) for held in blocks]
    if alone:
        found = reports[0]
    else:
        every = reports[0]
        for more in reports[1:]:
            every = every.unionByName(more)
        lists = every.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list(F.transform("entities", lambda e: F.struct(e["first"].alias("first"), (-e["words"]).alias("w"), e.alias("e")))))).alias("all"))
        start = F.struct(F.lit(0).alias("free"), F.expr(f"cast(array() as array<struct<{struct.replace(' ', ':').replace(',:', ',')}>>)").alias("kept"))
        step = lambda acc, m: F.when(m["first"] >= acc["free"], F.struct((m["first"] - m["w"]).alias("free"), F.concat(acc["kept"], F.array(m["e"])).alias("kept"))).otherwise(acc)
        found = lists.select("k", F.aggregate("all", start, step)["kept"].alias("entities"))
    return texts.join(found.withColumnRenamed("k", "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
