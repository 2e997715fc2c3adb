"""Rows that count once, by one shuffle and one sort, without an aggregate that carries texts twice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def gathered(df: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """Rows of equal keys side by side, the least by `rest` first (nulls are least). Many keys spread over many tasks; what a Python stage reads next is the first of each, as first_of gives them."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *rest)


def first_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal keys, across batches too; nulls are equal."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        whole = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(len(whole), bool)
        for k in keys:
            c = whole.column(k)
            a, z = c.slice(0, len(c) - 1), c.slice(1)
            same = pc.if_else(pc.is_null(a), pc.is_null(z), pc.fill_null(pc.equal(a, z), False))
            new[1:] |= ~same.to_numpy(zero_copy_only=False)
        new[0] = last is None
        last = batch.slice(len(batch) - 1)
        if new.any():
            yield whole.filter(pa.array(new))
