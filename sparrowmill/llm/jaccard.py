"""N-gram Jaccard join: blocked product of the sparse document by n-gram matrix with itself.

The product's entry for two documents is the number of n-grams they share. Documents
with equal sets of n-grams are one row of the matrix.

1. Columns: n-grams stand in one order for all documents, frequent ones last (their
   frequencies, by powers of two, are kept in a table of fixed size). By the size-derived
   bound two sets can only be similar enough if they share an n-gram of the
   first n - ceil(s * n) + 1 ones of each, so only these columns form candidates.
2. Rows: columns of a few rows form all their pairs. In a longer one the row that has most columns in common with others is the
   column's centre; overlaps with it are counted for all rows of the column whose
   sizes allow a link. A group of near copies so needs a pair per row, not all pairs.
3. Linked rows become components. A longer column whose rows are in one component has
   nothing left to find; from the others the centre goes, and step 2 is repeated with
   the row most similar to it as centre, which is nearer to the middle of a group.
4. What is left is multiplied out block by block: each block of a column's rows meets
   each other block in a task of its own, which first counts the bits in which marks
   differ. Where few pairs are left, these are counted as above; else the task is given
   the sets, adds up overlaps over all n-grams, drops pairs below the bound, and returns
   only links that join components.

No pair of different sets that is similar enough is lost: it shares a column, and there it
is compared with the centre, multiplied out, or already joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.components import components
from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.llm.wordhash import LOWER, mix, windows, words_of
from sparrowmill.storage import drop_written, table, written

WIDTH = 3
PERCENT = 90
#: At most so many most frequent n-grams are put last, by a table of this many bytes.
FREQUENT = 1 << 20
SLOTS = 1 << 22
#: Counts below this are all alike.
RARE = 8
#: Rounds with a centre before columns are multiplied out; rows and n-grams of a block.
CENTRES = 2
#: Columns of so many rows at most form all their pairs at once.
FEW = 4
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1 << 21
#: Bytes of text signed at once and rows whose columns are chosen at once: what a batch takes lives on in the worker, in 16 and more bytes a byte of text.
SIGN_CHARS = 1 << 18
CHOOSE_ROWS = 250
#: Bits of the filter that names the sets to be fetched.
FETCH_BITS = 1 << 24
_SIGNED = "doc_id long, set_id long, n long, marks array<long>, grams array<long>"
_K = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Per text the hashes of its different n-grams, sorted; of texts with fewer words that of the whole sequence."""
    words = words_of([(t or "").encode() for t in texts], LOWER)
    grams, full = windows(words.hashes, width), words.room(width)
    shorter = {n: windows(words.hashes, n, salt=n) for n in range(1, width)}
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(grams[lo:hi][full[lo:hi]].view(np.int64)))
        else:
            out.append(shorter[hi - lo][lo : lo + 1].view(np.int64) if hi > lo else np.zeros(0, np.int64))
    return out


def _set_id(grams: np.ndarray) -> int:
    return int(mix(np.array([mix(grams.view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(grams))])).view(np.int64)[0])


def _marks(grams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams that fall on each of about half as many bits (a power of two, at least 64), as longs.

    A set's bits xor another's are the parities of the n-grams that only one of them has, so
    they are no more than those. A longer list folds onto a shorter one.
    """
    bits = 64 << max(0, (len(grams) // 128).bit_length())
    odd = np.bincount((mix(grams.view(np.uint64) ^ _K) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def signed_documents(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, set_id (equal for equal sets), n, marks and grams of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, chars=SIGN_CHARS):
            sets = gram_sets(batch.column("text").to_pylist(), width)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]), pa.int32()), pa.array(np.concatenate(x), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_set_id(s) for s in sets], pa.int64()), pa.array(n), listed([_marks(s) for s in sets]), listed(sets)], ["doc_id", "set_id", "n", "marks", "grams"])

    return map_texts(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sign, _SIGNED)


def needed(n: object, percent: int) -> object:
    """The least overlap of a set of size n with one similar enough: the ceiling of percent % of n."""
    return (n * percent + 99) // 100


def prefix(n: object, percent: int) -> object:
    """How many columns of a set of size n must hold one that a similar set has among its own first ones."""
    return n - needed(n, percent) + 1


def _slots(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two of size (a power of two) places for each n-gram."""
    g = grams.view(np.uint64)
    bits = np.uint64(64 - (size.bit_length() - 1))
    return ((g * _K) >> bits).astype(np.int64), (mix(g) >> bits).astype(np.int64)


def frequency_table(signed: DataFrame, percent: int) -> np.ndarray:
    """SLOTS bytes, two of which bound an n-gram's level: 0 below RARE documents, one more for each doubling.

    Counted are the first columns of every document by hash, twice as many as it needs.
    At most FREQUENT n-grams have a level: where more are frequent, the least frequent have none.
    """
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    seen = signed.where("n > 0").select(F.explode(F.slice("grams", 1, (2 * first).cast("int"))).alias("gram"))
    level = F.length(F.bin(F.shiftright("count", RARE.bit_length() - 1))).alias("level")
    counted = written(seen.groupBy("gram").count().where(F.col("count") >= RARE).select("gram", level), "frequent")
    sizes = {r["level"]: r["count"] for r in counted.groupBy("level").count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least - 1 in sizes and total + sizes[least - 1] <= FREQUENT or least > 1 and least - 1 not in sizes:
        least -= 1
        total += sizes.get(least, 0)
    levels = np.zeros(SLOTS, np.uint8)
    rows = counted.where(F.col("level") >= least).toArrow() if total else None
    if rows is not None:
        for slots in _slots(rows.column("gram").to_numpy(), SLOTS):
            np.maximum.at(levels, slots, rows.column("level").to_numpy().astype(np.uint8))
    drop_written(counted)
    return levels


def columns(signed: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """gram, set_id, n: the first columns of each different set, rare ones first."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, CHOOSE_ROWS) for whole in batches for lo in range(0, whole.num_rows, CHOOSE_ROWS)):
            own = batch.column("grams")
            grams, n = own.flatten().to_numpy(), own.value_lengths().to_numpy().astype(np.int64)
            a, b = (levels[s] for s in _slots(grams, len(levels)))
            owner, level = np.repeat(np.arange(len(n)), n), np.minimum(a, b)
            order = np.lexsort((level, owner))  # stable, and grams are sorted
            start = np.cumsum(n) - n
            chosen = order[np.arange(len(order)) - np.repeat(start, n) < np.repeat(prefix(n, percent), n)]
            upto = np.concatenate([[0], np.cumsum(np.minimum(prefix(n, percent), n))])
            listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(grams[chosen]))
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), batch.column("n"), listed], ["set_id", "n", "grams"])

    # Below this size only an equal set is similar enough.
    least = next(n for n in range(1, 202) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
    chosen = map_texts(signed.where(F.col("n") >= least).select("set_id", "n", "grams"), choose, "set_id long, n long, grams array<long>")
    once = chosen.groupBy("set_id").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    return once.select("set_id", "n", F.explode("grams").alias("gram"))


def _shared(rows: DataFrame) -> DataFrame:
    """rows (gram, set_id, n) of columns with two rows or more, with the rows of the column, and how many such columns a set has."""
    rows = written(rows, "columns")
    several = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared")
    kept = rows.join(several, "gram").withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("set_id")).cast("double"))
    kept = written(kept, "columns")
    drop_written(rows)
    drop_written(several)
    return kept


def _sizes_allow(a: str, b: str, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _may(marks_a: F.Column, marks_b: F.Column, n_a: F.Column, n_b: F.Column, percent: int) -> F.Column:
    """Whether as many n-grams as the marks tell apart leave two sets similar enough."""
    size = F.least(F.size(marks_a), F.size(marks_b))
    folded = lambda marks, i: F.aggregate(F.sequence(i, F.size(marks), size), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.element_at(marks, k)))
    apart = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda acc, i: acc + F.bit_count(folded(marks_a, i).bitwiseXOR(folded(marks_b, i))))
    return apart * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that sizes and marks allow to be similar enough."""
    side = lambda k: marks.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("marks").alias(f"marks_{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(_may(F.col("marks_a"), F.col("marks_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter, as FETCH_BITS bits in bytes, of the set_ids of ids; made of words, so that no more than its size comes to the driver."""
    places = [F.shiftrightunsigned(F.xxhash64("set_id", F.lit(k)), 64 - (FETCH_BITS.bit_length() - 1)) for k in range(2)]
    bits = ids.select(F.explode(F.array(*places)).alias("at"))
    words = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    held = words.toArrow()
    out = np.zeros(FETCH_BITS // 64, np.int64)
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return out.view(np.uint8)


def _fetched(signed: DataFrame, ids: DataFrame) -> DataFrame:
    """set_id, n, grams of the sets of ids (set_id), each once; a stored table.

    A filter keeps most others out of the shuffle. Only places in it go to Python, as sets
    of all rows would fill Arrow buffers on both sides of the pipe.
    """
    ids = written(ids.distinct(), "wanted")
    bits = _filter_of(ids)
    places = [F.shiftrightunsigned(F.xxhash64("set_id", F.lit(k)), 64 - (FETCH_BITS.bit_length() - 1)) for k in range(2)]

    @F.arrow_udf("boolean")
    def passing(first: pa.Array, second: pa.Array) -> pa.Array:
        held = lambda at: bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return pa.array((held(first.to_numpy()) & held(second.to_numpy())).astype(bool))

    likely = signed.where("n > 0").select("set_id", "n", "grams").where(passing(*places))
    once = likely.groupBy("set_id").agg(F.first("n").alias("n"), F.first("grams").alias("grams")).join(ids, "set_id", "left_semi")
    return written(once, "fetched")


def _counted(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b), near (the part of their union that they share), and whether that is enough; a stored table."""
    sets = _fetched(signed, pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")))
    side = lambda k: sets.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("grams").alias(f"grams_{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("grams_a", "grams_b")))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    out = written(met.select("a", "b", (F.col("both") / union).alias("near"), (F.col("both") * 100 >= union * percent).alias("linked")), "counted")
    drop_written(sets)
    return out


def product(grams: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all pairs of sets: columns with many rows are multiplied as dense blocks, the others row by row."""
    size = len(grams)
    sizes = np.fromiter(map(len, grams), np.int64, size)
    _, column = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(size), sizes)
    held = np.bincount(column)
    total = np.zeros((size, size), np.float32)
    dense = np.flatnonzero(held > max(4, size // 16))
    for lo in range(0, len(dense), 1024):
        number = np.full(len(held), -1)
        number[dense[lo : lo + 1024]] = np.arange(len(dense[lo : lo + 1024]))
        inside = number[column] >= 0
        x = np.zeros((size, len(dense[lo : lo + 1024])), np.float32)
        x[row[inside], number[column[inside]]] = 1
        total += x @ x.T
    thin = (held > 1) & (held <= max(4, size // 16))
    inside = thin[column]
    row, column = row[inside], column[inside]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    start, count = np.searchsorted(column, column), held[column]
    for ahead in range(1, int(count.max(initial=1))):
        # Each row of a column with the one so many places further on.
        place = np.flatnonzero(np.arange(len(column)) - start + ahead < count)
        np.add.at(total, (row[place], row[place + ahead]), 1)
        np.add.at(total, (row[place + ahead], row[place]), 1)
    return total


def _joining(ids: np.ndarray, labels: np.ndarray, linked: np.ndarray) -> pa.Table:
    """As many of the links as join all components of a block, no more than its rows."""
    root = {v: v for v in labels.tolist()}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out: list[tuple[int, int]] = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked)))):
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b:
            root[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _block_product(rows: pa.Table, percent: int) -> pa.Table:
    """Links of a block pair that join components."""
    rows = rows.combine_chunks()
    ids, labels, n = (rows.column(c).to_numpy() for c in ("set_id", "label", "n"))
    grams = rows.column("grams").combine_chunks()
    upto = np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
    flat = grams.flatten().to_numpy()
    total = product([flat[lo:hi] for lo, hi in zip(upto, upto[1:])])
    linked = labels[:, None] != labels[None, :]
    for lo in range(0, len(ids), 128):
        own = slice(lo, lo + 128)
        overlap = total[own].astype(np.int64)
        linked[own] &= overlap * 100 >= (n[own, None] + n[None, :] - overlap) * percent
    return _joining(ids, labels, linked)


def possible(n: np.ndarray, marks: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets sizes and marks allow to be similar enough, as a matrix."""
    out = np.zeros((len(n), len(n)), bool)
    widths = np.fromiter(map(len, marks), np.int64, len(n))
    kinds = np.unique(widths)
    for w in kinds.tolist():
        for v in kinds[kinds <= w].tolist():
            a, b = np.flatnonzero(widths == v), np.flatnonzero(widths == w)
            x = np.stack([marks[k] for k in a]).view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
            y = np.bitwise_xor.reduce(np.stack([marks[k] for k in b]).view(np.uint64).reshape(len(b), w // v, v), axis=1)
            for lo in range(0, len(a), 64):
                own = a[lo : lo + 64]
                apart = np.bitwise_count(x[lo : lo + 64, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                small, large = np.minimum(n[own][:, None], n[b][None, :]), np.maximum(n[own][:, None], n[b][None, :])
                near = (apart * (100 + percent) <= (small + large) * (100 - percent)) & (small * 100 >= large * percent)
                out[np.ix_(own, b)] |= near
                out[np.ix_(b, own)] |= near.T
    return out


def _block_pairs(rows: pa.Table, percent: int) -> pa.Table:
    """The possible pairs of a block pair between components; of a block with more of them than four a row its number instead."""
    rows = rows.combine_chunks()
    ids, labels, n = (rows.column(c).to_numpy() for c in ("set_id", "label", "n"))
    marks = [np.array(m, np.int64) for m in rows.column("marks").to_pylist()]
    i, j = np.nonzero(np.triu(possible(n, marks, percent) & (labels[:, None] != labels[None, :])))
    dense = len(i) > 4 * len(ids)
    at = [None] if dense else range(len(i))
    pick = lambda x, k: pa.array([None] if dense else x[k].tolist(), pa.int64())
    return pa.table({"block": pa.array([rows.column("block")[0].as_py() if dense else None] * len(at), pa.string()), "a": pick(ids, i), "b": pick(ids, j)})


def _multiplied(left: DataFrame, marks: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Links within the columns left (gram, set_id, n, label), found block by block."""
    per = left.groupBy("gram").agg(F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).alias("who"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    once = per.groupBy("who", "rows").agg(F.min(F.struct("gram", "size")).alias("g"))  # columns with the same rows count once
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("g.size") / BLOCK_GRAMS)).cast("int")
    chosen = written(once.select("g.gram", blocks.alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("set_id", F.lit(1)), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = left.join(chosen, "gram").withColumn("own", own).withColumn("other", other)
    block = F.concat_ws("/", "gram", F.least("own", "other"), F.greatest("own", "other"))
    dealt = written(dealt.select(block.alias("block"), "set_id", "n", "label"), "dealt")
    told = dealt.join(marks.select("set_id", "marks"), "set_id").groupBy("block").applyInArrow(lambda rows: _block_pairs(rows, percent), "block string, a long, b long")
    told = written(told, "told")
    links_ = _counted(written(told.where("block is null").select("a", "b").distinct(), "pairs"), signed, percent).where("linked").select("a", "b")
    dense = written(dealt.join(told.where("block is not null").select("block"), "block"), "dense")
    if dense.isEmpty():
        return links_
    filled = dense.join(_fetched(signed, dense.select("set_id")).select("set_id", "grams"), "set_id")
    return links_.union(written(filled.groupBy("block").applyInArrow(lambda rows: _block_product(rows, percent), "a long, b long"), "links"))


def links(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: set_ids of different sets of signed (set_id, n, marks, grams) that are similar enough; as many as join all of a component."""
    rows = _shared(columns(signed, frequency_table(signed, percent), percent))
    marks = written(signed.where("n > 0").select("set_id", "n", "marks").groupBy("set_id").agg(F.first("n").alias("n"), F.first("marks").alias("marks")), "marks")
    few = rows.where(F.col("rows") <= FEW).select("gram", "set_id", "n")
    twice = few.join(few.select("gram", F.col("set_id").alias("b"), F.col("n").alias("n_b")), "gram").where(F.col("set_id") < F.col("b"))
    met = written(twice.where(_sizes_allow("n", "n_b", percent)).select(F.col("set_id").alias("a"), "b").distinct(), "pairs")
    found = _counted(written(_likely(met, marks, percent), "likely"), signed, percent).where("linked").select("a", "b")
    drop_written(met)
    left = written(rows.where(F.col("rows") > FEW).drop("rows"), "left")
    for k in range(CENTRES):
        if left.isEmpty():
            return found
        labels = written(components(found).select(F.col("node").alias("set_id"), F.col("root").alias("label")), "labels")
        left = _mixed(left, labels)
        centre = left.groupBy("gram").agg(F.max(F.struct("met", F.xxhash64("set_id").alias("h"), F.col("set_id").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"))).alias("c"))
        centre = written(centre.select("gram", "c.b", "c.label_b", "c.n_b"), "centres")
        met = written(left.join(centre, "gram").where(F.col("set_id") != F.col("b")), "met")
        wanted = met.where(_sizes_allow("n", "n_b", percent) & (F.col("label") != F.col("label_b"))).select(F.col("set_id").alias("a"), "b").distinct()
        counted = _counted(written(_likely(wanted, marks, percent), "likely"), signed, percent)
        found = found.union(counted.where("linked").select("a", "b"))
        near = counted.select(F.col("a").alias("set_id"), "b", "near")
        left = written(met.join(near, ["set_id", "b"], "left").select("gram", "set_id", "n", F.coalesce("near", F.lit(0.0)).alias("met")), "left")
    labels = written(components(found).select(F.col("node").alias("set_id"), F.col("root").alias("label")), "labels")
    left = _mixed(left, labels)
    return found if left.isEmpty() else found.union(_multiplied(left, marks, signed, percent))


def _mixed(left: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with label, of those columns whose rows aren't all in one component; a stored table."""
    told = written(left.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "told")
    mixed = written(told.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram"), "mixed")
    return written(told.join(mixed, "gram"), "left")


def jaccard_components(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (different ones), component_id (smallest doc_id reachable by links), one row for each input row.

    Two rows link when their sets' intersection has at least percent % of their union's size.
    Null and empty texts have an empty set and link with nothing, not even each other.
    Rows without doc_id link as others do but name no component; where a whole component has no
    doc_id its component_id is null. Repeated rows stay. Other columns aren't read;
    an empty table gives no row. n-grams and sets are told apart by 64-bit hashes.
    """
    signed = written(signed_documents(documents, width), "sets")
    labels = components(links(signed, percent)).select(F.col("node").alias("set_id"), F.col("root").alias("label"))
    rows = signed.select("doc_id", "set_id", "n")
    least = written(rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least")).join(labels, "set_id", "left"), "least")
    label = F.coalesce("label", "set_id").alias("label")
    of_label = written(least.groupBy(label).agg(F.min("least").alias("component_id")), "component")
    of_set = written(least.select("set_id", label).join(of_label, "label").select("set_id", "component_id"), "of_set")
    linked = rows.where("n > 0").join(of_set, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) END AS g FROM w
), u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN pairs AS p ON r.b = p.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON s.doc_id = c.a
"""
