"""Tables of a page rebuilt from where its words stand.

Words whose heights overlap form a line, words of a line closer than a gap form a run. Lines
of two runs or more are lines of a table; other lines part one table from the next. The
columns of a table are the stretches that its runs leave free of gaps when all are
laid over each other. The words of a page follow each other in one partition, so
pages are spread over all tasks and no page meets another; a task holds the words of one
page and of one batch at a time, with numpy over all pages of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ("source_url", "page")
_PLACE = ("x0", "x1", "y0", "y1")


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before in any key; the first row does."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _islands(group: np.ndarray, order: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, gap: float) -> np.ndarray:
    """The number, over all groups and in their order, of the stretch of overlapping [lo, hi) in which each row lies; stretches less than gap apart are one."""
    at = np.lexsort([*reversed(order), group])
    g, starts, ends = group[at], lo[at], hi[at]
    fresh = _changes(g)
    # The greatest end so far in each group: ranks of ends, lifted by the group, never fall from one group to the next.
    values, rank = np.unique(ends, return_inverse=True)
    number = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(rank + number * len(values)) - number * len(values)
    begins = fresh.copy()
    if len(at):
        # As Spark orders them, NaN is greater than all.
        begins[1:] |= (starts[1:] >= values[reach[:-1].clip(0)] + gap) | np.isnan(starts[1:])
    out = np.empty(len(at), np.int64)
    out[at] = np.cumsum(begins) - 1
    return out


def _tables(page: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, word: pa.Array, gap: float) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """page, table_no and rows of the tables of words, whose pages are numbered in order."""
    spelt = pc.rank(word, tiebreaker="dense").to_numpy().astype(np.int64)
    line = _islands(page, [y0, y1, x0, spelt], y0, y1, 0.0)
    run = _islands(line, [x0, x1, spelt], x0, x1, gap)
    # Lines are numbered over all pages, and so are runs: a line is tabular where its runs are more than one.
    lines, first = np.unique(line, return_index=True)
    several = np.bincount(line[np.unique(run, return_index=True)[1]], minlength=len(lines)) > 1
    page_of = page[first]
    opens = _changes(page_of)
    opens[1:] |= ~several[:-1]
    # Stretches of lines between others; those without a tabular line hold none of the words that are left.
    stretch = np.cumsum(opens) - 1
    keep = np.flatnonzero(several[line])
    _, table = np.unique(stretch[line[keep]], return_inverse=True)
    line, x0, x1, y0, spelt, page, number = line[keep], x0[keep], x1[keep], y0[keep], spelt[keep], page[keep], keep
    cell = _islands(table, [x0, x1, line, spelt], x0, x1, gap)
    at = np.lexsort([spelt, y0, x0, cell, line])
    line, cell, table, page = line[at], cell[at], table[at], page[at]
    starts = np.flatnonzero(_changes(line, cell))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(np.append(starts, len(at)), word.take(pa.array(number[at])).cast(pa.large_string())), pa.scalar(" ", pa.large_string()))
    # Each table's cells are numbered on from the one before; a row has as many as its table.
    tables, table_first = np.unique(table, return_index=True)
    low = np.full(len(tables), np.iinfo(np.int64).max)
    high = np.full(len(tables), -1)
    np.minimum.at(low, table, cell)
    np.maximum.at(high, table, cell)
    width = high - low + 1
    row_first = np.flatnonzero(_changes(line))
    row_width = width[table[row_first]]
    begin = np.concatenate([[0], np.cumsum(row_width)])
    slot = np.full(begin[-1], -1)
    row_of = np.cumsum(_changes(line)) - 1
    slot[begin[row_of[starts]] + cell[starts] - low[table[starts]]] = np.arange(len(starts))
    texts = pc.fill_null(joined.take(pa.array(slot, mask=slot < 0)), pa.scalar("", pa.large_string())).cast(pa.string())
    cells = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), texts)
    per_table = np.bincount(table[row_first], minlength=len(tables))
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_table)]), pa.int32()), cells)
    of = page[table_first]
    nth = np.arange(len(of)) - np.maximum.accumulate(np.where(_changes(of), np.arange(len(of)), 0)) + 1
    return of, nth, rows


def tables_of_words(words: DataFrame, gap: float, together: bool = False) -> DataFrame:
    """source_url, page, table_no, rows (array of arrays of text) from words (source_url, page, x0, x1, y0, y1, word).

    gap: the least free width between columns, more than a space's. Empty cells are empty texts; words without place or text don't count.
    together: the words of a page follow each other in one partition already; else they are shuffled and sorted by page.
    """
    placed = words.where("x0 is not null and x1 is not null and y0 is not null and y1 is not null and trim(word) <> ''")
    placed = placed.select(F.col("source_url").cast("string").alias("source_url"), "page", *[F.col(c).cast("double").alias(c) for c in _PLACE], "word")
    if not together:
        placed = placed.repartition(*PAGE).sortWithinPartitions(*PAGE)

    def rebuilt(batch: pa.Table) -> pa.RecordBatch:
        begins = _page_changes(batch)
        of, table_no, rows = _tables(np.cumsum(begins) - 1, *[batch.column(c).to_numpy() for c in _PLACE], _whole(batch.column("word")), gap)
        first = pa.array(np.flatnonzero(begins)[of])
        return pa.RecordBatch.from_arrays([*[_whole(batch.column(c)).take(first) for c in PAGE], pa.array(table_no, pa.int64()), rows], [*PAGE, "table_no", "rows"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The batch's last page may go on; a page that fills whole batches waits until it ends, and is put together once.
            last = int(np.flatnonzero(_page_changes(pa.Table.from_batches([batch])))[-1])
            if last or (held and not _same_page(held[-1], batch)):
                yield rebuilt(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield rebuilt(pa.Table.from_batches(held))

    kind = placed.schema["page"].dataType.simpleString()
    return placed.mapInArrow(pages, f"source_url string, page {kind}, table_no bigint, rows array<array<string>>")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _page_changes(table: pa.Table) -> np.ndarray:
    """Where a page begins, null being a value like others."""
    return _changes(*[_whole(table.column(c)).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in PAGE])


def _same_page(one: pa.RecordBatch, other: pa.RecordBatch) -> bool:
    return all(one.column(c)[one.num_rows - 1].as_py() == other.column(c)[0].as_py() for c in PAGE)
