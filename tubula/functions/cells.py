"""Whole groups of rows in batches: what a task computes for many small groups at once, with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def in_groups(df: DataFrame, keys: list[str], sort: list[str], run: Callable[[pa.Table, np.ndarray], Iterable[pa.Table]], schema) -> DataFrame:
    """run(rows, begin) over batches of whole groups in order: one exchange by the keys and one sort. begin: where each
    group begins, and the number of rows. A task holds a batch and at most one group beyond it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _whole(batches, keys):
            for out in run(rows, begin):
                yield from pa.table(out.columns, out.column_names).to_batches()  # every batch with the same fields

    return df.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInArrow(work, schema)


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row but the first has another key than the row before it; two nulls are the same key."""
    other = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        c = rows.column(k).combine_chunks()
        a, b = c.slice(0, len(other)), c.slice(1)
        null = c.is_null().to_numpy(zero_copy_only=False)
        other |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    return other


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held: list[pa.RecordBatch] = []  # rows from the beginning of the last group on

    def table(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        return rows, np.concatenate([[0], np.flatnonzero(_changes(rows, keys)) + 1, [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            near = [held[-1].slice(held[-1].num_rows - 1), batch]
            at = np.flatnonzero(_changes(pa.Table.from_batches(near), keys))
        else:
            at = np.append(0, np.flatnonzero(_changes(pa.Table.from_batches([batch]), keys)) + 1)
        if not len(at):
            held.append(batch)
            continue
        last = int(at[-1])
        done = [*held, batch.slice(0, last)] if last else held
        if done:
            yield table(done)
        held = [batch.slice(last)]
    if held:
        yield table(held)


def by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of about the same size (places in ``sizes``), so that matrices of them are at most half padding."""
    if len(sizes):
        level = np.frexp(np.maximum(sizes, 1) - 0.5)[1]
        for k in np.unique(level):
            yield np.flatnonzero(level == k)


def padded(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A line of row numbers for each group, as wide as the largest; smaller ones repeat their last row."""
    return begin[:, None] + np.minimum(np.arange(size.max(initial=1)), size[:, None] - 1)


def numbers(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values, NaN for NULL, and which are NULL."""
    c = rows.column(name).combine_chunks()
    value = c.cast(pa.float64()).fill_null(np.nan)
    return value.to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)


def column(value: np.ndarray, null: np.ndarray) -> pa.Array:
    """Values as a column; NaN is NULL where ``null`` says that it comes from one."""
    return pa.array(value, pa.float64(), mask=null & np.isnan(value))
