"""Whole sheets, many at a time, to a function of Arrow batches: no call for each sheet, and none split between calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..model import KEY


def sheet_numbers(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """For rows in order of their sheets: the sheet's number from 0."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for name in KEY:
        col = batch.column(name)
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sheet = sheet_numbers(batch)
        last = int(np.searchsorted(sheet, sheet[-1]))  # the last sheet may go on in the next batch
        if held and any(held[-1].column(x)[-1] != batch.column(x)[0] for x in KEY):
            if not last:
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def by_sheets(df: DataFrame, order: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What fn makes of whole sheets, each sheet's rows in the order given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            yield from fn(rows.combine_chunks()).to_batches()

    return df.repartition(*KEY).sortWithinPartitions(*KEY, *order).mapInArrow(run, schema)
