"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram (at most ``capacity`` numbers) comes to the driver. There the
program "use configurations (what one sequence holds) so that every length occurs
as often as it is there, in as few sequences as the bound allows" is solved by
multiplicative weights. A round prices all configurations at once by a knapsack
dynamic program over rooms: a configuration's amount is in proportion to the
product of its pieces' weights, and a length's weight moves by wanted over found.
The amounts are rounded: configurations are drawn by their amounts, walking the
knapsack back, and dealt whole times as far as pieces are left. The program is
solved again for the pieces left, up to PHASES times; best fit decreasing, on runs
of equal bins, packs the few left then. Of the states after each phase (and best
fit decreasing alone) the one with the fewest sequences is the plan, the latest
of equals. The work doesn't depend on how many
pieces there are. The plan says where the r-th piece of each length goes; pieces
learn r from counts per (length, hash bucket), with buckets of about BUCKET_ROWS
rows at most, however many equal rows there are.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.storage import table, written

CAPACITY = 2048
ROUNDS = 40
GAP = 0.01
DRAWS = 4096
PHASES = 12
BUCKETS = 256
BUCKET_ROWS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Each text's ids and end_id after them, cut into pieces of capacity ids, the last may be shorter.

    A null text counts as empty: one piece that holds end_id alone. Rows with
    equal or null doc_id give pieces of their own each. keep_ids adds the ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparrowmill.llm.bpe_fst import transducer

        fst = transducer(path)
        for batch in text_slices(batches):
            names, out = batch.column("doc_id").to_pylist(), defaultdict(list)
            for doc, ids in zip(names, fst.ids(batch.column("text").to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for key, value in (("doc_id", doc), ("piece", k), ("start", start), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                        out[key].append(value)
                    if keep_ids:
                        out["ids"].append(part.astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, kinds)], list(out))

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(rows, cut, PIECES + ", ids array<int>" * keep_ids)


# -- the plan, on the driver ------------------------------------------------


def _dearest(lengths: np.ndarray, price: np.ndarray, limit: np.ndarray, capacity: int) -> float:
    """The knapsack: the highest sum of prices in one sequence, each length at most limit times."""
    best = np.zeros(capacity + 1)
    for size, value, n in zip(lengths.tolist(), price.tolist(), limit.tolist()):
        step = 1
        while n > 0 and value > 0:
            k = min(step, n)
            np.maximum(best[k * size :], best[: capacity + 1 - k * size] + k * value, out=best[k * size :])
            n, step = n - k, step * 2
    return float(best[capacity])


def _multiples(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """All (index of length, times) that fit alone into a sequence."""
    most = capacity // lengths
    item = np.repeat(np.arange(len(lengths)), most)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(most) - most, most) + 1


def _soft_knapsack(sigma: np.ndarray) -> np.ndarray:
    """For each room the sum, over all ways to fill it, of the product of their pieces' weights.

    sigma[s]: the sum of length * weight**times over what fills s places by one length alone.
    """
    ways = np.zeros(len(sigma))
    ways[0] = 1
    for r in range(1, len(sigma)):
        ways[r] = sigma[r:0:-1] @ ways[:r] / r
    return ways


class Program:
    """The configuration program at a fixed number of sequences, solved by multiplicative weights.

    A configuration's amount is in proportion to the product of its pieces' weights,
    so one knapsack program over rooms prices all configurations of a round, and
    tells how often each length occurs in a sequence on average. Weights then move
    by wanted over found. Empty places are pieces of length 1, as many as there must be.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int, sequences: float):
        empty = max(sequences * capacity - float((lengths * counts).sum()), 1e-3 * sequences)
        self.lengths, self.capacity = np.append(lengths, 1), capacity
        self.wanted = np.append(counts, empty) / sequences
        self.item, self.times = _multiples(self.lengths, capacity)
        self.size = self.lengths[self.item] * self.times
        self.log_weight = np.log(self.wanted / (1 + self.wanted))

    def _price(self) -> tuple[float, np.ndarray]:
        """The logarithm of the sum over all configurations less what is wanted of it, and how often each length occurs.

        Weights are scaled first, which changes nothing for full sequences, so that sums stay in range.
        """
        scale = 0.0
        for _ in range(60):
            power = np.exp(np.clip((self.log_weight + scale * self.lengths)[self.item] * self.times, -700, 300))
            sigma = np.bincount(self.size, self.lengths[self.item] * power, self.capacity + 1)
            with np.errstate(over="ignore", invalid="ignore"):
                ways = _soft_knapsack(sigma)
            top = ways[self.capacity]
            if np.isfinite(ways).all() and 1e-100 < top < 1e100:
                break
            high = not np.isfinite(ways).all() or top >= 1e100
            scale += (-1 if high else 1) * (0.1 if not np.isfinite(top) or top <= 0 else min(0.1, abs(np.log(top)) / self.capacity))
        self.log_weight = self.log_weight + scale * self.lengths
        self.power, self.sigma, self.ways = power, sigma, ways
        found = np.bincount(self.item, power * ways[self.capacity - self.size], len(self.lengths)) / top
        return float(np.log(top) - self.wanted @ self.log_weight), found

    def solve(self, rounds: int) -> float:
        """The share of the pieces' tokens that the amounts leave uncovered at the end.

        A round that doesn't lower the dual is taken back, and the next one moves half as far.
        """
        volume, pace = (self.wanted * self.lengths)[:-1], 1.0
        value, found = self._price()
        for _ in range(rounds):
            short = float(np.maximum(0, self.wanted - found)[:-1] @ self.lengths[:-1]) / float(volume.sum())
            if short <= GAP or pace < 1e-4:
                break
            move = np.log(np.clip(self.wanted / np.maximum(found, 1e-30), 0.1, 10)) / (1 + np.maximum(found, self.wanted))
            held = self.log_weight
            self.log_weight = held + pace * move
            new, now = self._price()
            if new <= value:
                value, found, pace = new, now, min(1.0, pace * 1.5)
            else:
                self.log_weight, pace = held, pace / 2
                self._price()
        return short

    def draw(self, n: int, rng: np.random.Generator) -> dict[tuple[tuple[int, int], ...], int]:
        """n configurations, each with its amount's chance: ((index of length, times), ...) and how often it was drawn."""
        rooms = np.arange(self.capacity + 1)
        table = np.zeros((self.capacity + 1, self.capacity + 1))
        for r in rooms[1:]:
            row = np.cumsum(self.sigma[: r + 1] * self.ways[r::-1])
            table[r, : r + 1] = row / row[-1] if row[-1] > 0 else 1
            table[r, r:] = 1
        steps = (table + rooms[:, None]).ravel()
        order = np.argsort(self.size, kind="stable")
        cost = np.cumsum((self.lengths[self.item] * self.power)[order])
        first = np.searchsorted(self.size[order], rooms)
        base = np.concatenate([[0.0], cost])
        room, live, drawn = np.full(n, self.capacity), np.arange(n), []
        while len(live):
            now = room[live]
            size = np.searchsorted(steps, now + rng.random(len(live)) * (1 - 1e-12), "right") - now * (self.capacity + 1)
            size = np.clip(size, 1, now)
            low, high = base[first[size]], base[np.append(first, len(order))[size + 1]]
            pick = np.searchsorted(cost, low + rng.random(len(live)) * (high - low), "right")
            which = order[np.clip(pick, first[size], np.append(first, len(order))[size + 1] - 1)]
            drawn.append(np.stack([live, self.item[which], self.times[which]]))
            room[live] = now - size
            live = live[room[live] > 0]
        who, item, times = np.concatenate(drawn, axis=1)
        real = item < len(self.lengths) - 1
        key, at = np.unique(who[real] * len(self.lengths) + item[real], return_inverse=True)
        total = np.bincount(at, times[real]).astype(int)
        parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in zip(key.tolist(), total.tolist()):
            parts[k // len(self.lengths)].append((k % len(self.lengths), t))
        found: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
        for x in parts.values():
            found[tuple(reversed(x))] += 1
        return found


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """At least so many sequences, by the dual program: total price over the knapsack's dearest sequence.

    Prices: in proportion to lengths, and how many halves, thirds ... of a sequence a piece exceeds.
    """
    limit, best = np.minimum(counts, capacity // lengths), float((lengths * counts).sum()) / capacity
    for k in range(2, 8):
        price = (k * lengths // (capacity + 1)).astype(float)
        if price.any():
            best = max(best, float(price @ counts) / _dearest(lengths, price, limit, capacity))
    return best


def _rounded(drawn: dict[tuple[tuple[int, int], ...], int], each: float, lengths: np.ndarray, counts: np.ndarray, capacity: int, spare: float) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], np.ndarray]:
    """Each configuration the whole part of each times as often as drawn, as far as pieces are left, with at most spare empty places.

    The fullest come first, of them those without short pieces, which fill what is left later.
    """
    left, chosen = counts.copy(), []
    full = {parts: sum(k * int(lengths[j]) for j, k in parts) for parts in drawn}
    for parts in sorted(drawn, key=lambda parts: (-full[parts], -parts[-1][0], parts)):
        n = min([int(drawn[parts] * each), *(int(left[j]) // k for j, k in parts)])
        if full[parts] < capacity:
            n = int(min(n, spare // (capacity - full[parts])))
        if n > 0:
            chosen.append((parts, n))
            spare -= n * (capacity - full[parts])
            for j, k in parts:
                left[j] -= n * k
    return chosen, left


def best_fit_runs(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing on runs of equal bins: ((length, times), ...) and the number of such bins."""
    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    for size, n in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        while n:
            room = min((r for r in rooms if r >= size), default=None)
            inside, many = ((), -1) if room is None else rooms[room].pop()
            if room is not None and not rooms[room]:
                del rooms[room]
            room = capacity if room is None else room
            each = room // size
            bins = n // each if many < 0 else min(many, n // each)
            if bins:
                rooms[room - each * size].append(((*inside, (size, each)), bins))
                n -= bins * each
            if n and (many < 0 or bins < many):  # fewer than a bin takes
                rooms[room - n * size].append(((*inside, (size, n)), 1))
                bins, n = bins + 1, 0
            if many > bins:
                rooms[room].append((inside, many - bins))
    return [x for r in sorted(rooms) for x in rooms[r]]


def _first_part(dealt: list[tuple[tuple[tuple[int, int], ...], int]], most: int, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list, list]:
    """The first sequences, at most so many, of dealt, and best fit decreasing of all other pieces."""
    part, left = [], dict(zip(lengths.tolist(), counts.tolist()))
    for inside, n in dealt:
        n = min(n, most)
        if n:
            part.append((inside, n))
            most -= n
            for size, k in inside:
                left[size] -= n * k
    rest = np.asarray(sorted((size, n) for size, n in left.items() if n), np.int64).reshape(-1, 2)
    return part, best_fit_runs(rest[:, 0], rest[:, 1], capacity)


@dataclass
class Plan:
    """Where pieces go: those of one length from rank lo on, each at a time, to sequence first, first + 1, ..."""

    length: np.ndarray
    lo: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: float
    from_lp: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.length << 44 | self.lo, length << 44 | rank, "right") - 1
        i = rank - self.lo[k]
        return self.first[k] + i // self.each[k], self.offset[k] + i % self.each[k] * length


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """histogram: how often each length from 1 to capacity occurs; its size bounds all work here. from_lp: sequences that the program gave."""
    lengths = np.asarray(sorted(histogram), np.int64)
    counts = np.asarray([histogram[k] for k in lengths.tolist()], np.int64)
    tokens, dealt, left, rng = int((lengths * counts).sum()), [], counts, np.random.default_rng(0)
    bound = lower_bound(lengths, counts, capacity) if len(lengths) else 0.0
    runs, from_lp = best_fit_runs(lengths, counts, capacity), 0
    fewest = target = sum(n for _, n in runs)
    bins = 0
    for _ in range(PHASES):
        live = np.flatnonzero(left)
        if not len(live):
            break
        open_ = int((lengths * left).sum())
        wanted = max(target - bins, open_ / capacity)
        program = Program(lengths[live], left[live], capacity, wanted)
        program.solve(rounds)
        draws = max(1, min(DRAWS, int(wanted)))
        spare = max(0.0, wanted * capacity - open_)
        chosen, rest = _rounded(program.draw(draws, rng), wanted / draws, lengths[live], left[live], capacity, spare)
        if not chosen:
            break
        dealt += [(tuple((int(lengths[live[j]]), k) for j, k in parts), n) for parts, n in chosen]
        left = left.copy()
        left[live] = rest
        bins = sum(n for _, n in dealt)
        others = best_fit_runs(lengths[left > 0], left[left > 0], capacity)
        total = bins + sum(n for _, n in others)
        if total <= fewest:
            runs, from_lp, fewest = dealt + others, bins, total
    share = 0.95
    while dealt and not from_lp and share > 0.1:  # fewer of them, the last of which have the short pieces
        part, others = _first_part(dealt, int(share * bins), lengths, counts, capacity)
        if sum(n for _, n in part + others) <= fewest:
            runs, from_lp = part + others, sum(n for _, n in part)
        share *= 0.9
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for inside, n in runs:
        offset = 0
        for size, each in inside:
            rows.append((size, used[size], first, each, offset))
            used[size] += each * n
            offset += size * each
        first += n
    cols = np.asarray(sorted(rows), np.int64).reshape(-1, 5).T.copy()
    return Plan(*cols, first, bound, from_lp)


def packed(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with sequence_id and offset, gapless from 0 in each sequence.

    pieces must be a stored table: it is read three times. Equal rows get places
    of their own; a column salt, if there, spreads them over buckets. An empty table
    gives an empty result.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = packing_plan(histogram, capacity, rounds)
    most = max(BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    spread = ["doc_id", "piece", "ids_crc32"] + ["salt"] * ("salt" in pieces.columns)
    pieces, keyed = pieces.drop("salt"), pieces.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(most))).drop("salt")
    sizes = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"])
    kept = pieces.columns
    ranked = ranked.select(*kept, (F.col("_before") + F.col("_in")).cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_texts(ranked, place, schema + ", sequence_id long, offset long")


def best_fit_packing(documents: DataFrame, path: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """All documents as pieces in as few sequences of at most capacity tokens as the method finds."""
    pieces = token_pieces(documents, path, capacity).withColumn("salt", F.monotonically_increasing_id())  # fixed once it is stored
    return packed(written(pieces, "pieces"), capacity, rounds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
