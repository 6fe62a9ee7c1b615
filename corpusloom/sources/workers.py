"""Rows through Python in bounded slices: what a worker holds depends on a slice, not on Spark's batches of 10,000 rows."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A worker turns so many rows, and so many bytes of text, into Python values at once; a longer row comes alone.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20
#: An Arrow batch on its way to a worker: Spark's own bound on its bytes, and the one that takes its place.
BATCH_BYTES, SPARK_BATCH, OWN_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def _bytes(b: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if any(is_(c.type) for is_ in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            out += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of record batches as lists by column, few at a time."""
    for b in batches:
        ends, at = np.cumsum(_bytes(b)), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = max(1, min(SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at))
            yield b.slice(at, n).to_pydict()
            at += n


def map_slices(rows: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterator[list[dict]]], fields: str) -> DataFrame:
    """Rows made per task: run gets the slices and yields lists of rows.  A task's memory goes back to the system at its end.

    A session with a bound of its own on the bytes of a batch keeps it."""
    spark = rows.sparkSession
    if spark.conf.get(BATCH_BYTES, SPARK_BATCH) == SPARK_BATCH:
        spark.conf.set(BATCH_BYTES, OWN_BATCH)
    kind = T.StructType.fromDDL(fields)
    schema = to_arrow_schema(kind)

    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            for out in run(slices(batches)):
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        finally:
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return rows.mapInArrow(task, kind)
