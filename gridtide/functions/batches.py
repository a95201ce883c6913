"""Work on Arrow batches: equal-length stacks and per-key sums without a Python loop per row."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa


def stacks(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of a column of arrays, one pair per array length."""
    lengths = column.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack(column.iloc[at].to_list())


def map_stacks(column: pd.Series, f) -> pd.Series:
    """Apply f (matrix -> matrix of as many rows) to the arrays of a column."""
    out = np.empty(len(column), dtype=object)
    for at, matrix in stacks(column):
        for i, row in zip(at, f(matrix)):
            out[i] = row
    return pd.Series(out, index=column.index)


def sums_by_key(keys: pd.DataFrame, values: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(distinct keys, row counts, summed rows of `values`) of rows keyed by `keys`."""
    codes = keys.groupby(list(keys.columns), sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
    counts = np.diff(np.r_[starts, len(codes)])
    return keys.iloc[order[starts]].reset_index(drop=True), counts, np.add.reduceat(values[order], starts, axis=0)


def _stack(column: pa.ChunkedArray, groups: int, rows: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(groups, rows, -1)


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of adjacent rows with equal keys begin."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= np.diff(codes) != 0
    return np.flatnonzero(new)


def group_stacks(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """(keys, stacks) of groups of adjacent rows with equal keys: one row of keys per group and, per column of arrays, a
    stack (groups, rows, length). Groups of one shape come together, and the last of a batch waits for the next batch.

    Arrays of one group must be equally long.
    """
    rest = None
    for batch in chain(batches, [None]):
        table = rest if batch is None else pa.Table.from_batches([batch])
        if rest is not None and batch is not None:
            table = pa.concat_tables([rest, table])
        if table is None or not table.num_rows:
            continue
        starts = starts_of(table, keys)
        if batch is not None:
            rest, table, starts = table.slice(starts[-1]), table.slice(0, starts[-1]), starts[:-1]
            if not len(starts):
                continue
        rows = np.diff(np.r_[starts, table.num_rows])
        lengths = table[columns[0]].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        if np.any(np.minimum.reduceat(lengths, starts) != np.maximum.reduceat(lengths, starts)):
            raise ValueError(f"arrays of one group of {keys} differ in length")
        shapes, which = np.unique(np.stack((rows, lengths[starts]), axis=1), axis=0, return_inverse=True)
        for i in range(len(shapes)):
            own = np.flatnonzero(which.ravel() == i)
            some = table
            if len(shapes) > 1:
                some = table.take(pa.array((starts[own][:, None] + np.arange(shapes[i][0])).ravel()))
            first = pa.array(np.arange(len(own)) * shapes[i][0])
            yield some.select(keys).take(first), [_stack(some[c], len(own), shapes[i][0]) for c in columns]
