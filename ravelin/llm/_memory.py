"""Memory of Python workers, which serve one task after the other and so keep what an allocator holds back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Options of the C library's mallopt, and the sizes from which blocks go back to the system when freed.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3
TRIM_BYTES, MMAP_BYTES = 16 << 20, 4 << 20
#: Bytes of input that a function takes at once.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_library: list = []


def tune():
    """Large blocks go back to the system when they are freed. The C library, or None if it is another one."""
    if not _library:
        try:
            library = ctypes.CDLL(None)
            library.mallopt(M_MMAP_THRESHOLD, MMAP_BYTES)
            library.mallopt(M_TRIM_THRESHOLD, TRIM_BYTES)
            library.malloc_trim
        except (OSError, AttributeError):  # another C library
            library = None
        _library.append(library)
    return _library[0]


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if library := tune():
        library.malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session come in ``BATCH_BYTES`` at most (and one row), unless it has a limit of its own: both sides
    of each Python function hold a whole batch."""
    if not spark.sparkContext.getConf().contains(BATCH_LIMIT):
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``BATCH_BYTES``, or of one row."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def frugal_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group's table, after which the worker holds no freed memory."""

    def held(table: pa.Table) -> pa.Table:
        tune()
        try:
            return run(table)
        finally:
            release()

    return held


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that reads its input in small pieces, and after which the worker holds no freed memory."""

    def held(batches: Iterator) -> Iterator:
        tune()
        try:
            yield from run(pieces(batches))
        finally:
            release()

    return held
