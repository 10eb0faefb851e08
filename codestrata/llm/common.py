"""Shared helpers: tables, keys of rows, grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.scratch import drop, save  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """64-bit hash of a text; null and empty differ."""
    return F.xxhash64(F.lit(17), text, text.isNull())


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``keys``, each as one table. Only one group is held at a time."""
    import numpy as np

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        change = np.zeros(part.num_rows, bool)
        for k in keys:
            col = part.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), part.num_rows]
        first = tuple(part.column(k)[0].as_py() for k in keys)
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if held and (n or first != last):
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
        last = tuple(part.column(k)[part.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.concat_tables(held)
