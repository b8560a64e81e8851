"""What the operators share: folds, bounded samples for fitting, and Arrow kernels over texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

HASH_RANGE = 1 << 31

#: Gives freed memory back to the system, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Rows that a kernel sees at once; bounds the Python objects that a worker holds.
KERNEL_ROWS = 1_000


_kept: dict[tuple, object] = {}
_asked = False


def kept_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing at a time, so that models and memos of a pipeline's stages do not add up."""
    global _asked
    _asked = True
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """At the end of a task: what the task did not ask for goes, and freed memory goes back to the system.

    Workers outlive their tasks, so what one stage needed at its peak would stay with them through all later stages.
    """
    global _asked
    if not _asked:
        _kept.clear()
    _asked = False
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ending(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow``, with ``let_go`` at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        let_go()

    return whole


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key counts as in the fold."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(modulus)) == remainder, F.lit(True))


def bounded_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the columns, so that reruns choose the same.

    Only for fitting models of a documented size; a table that is smaller stays whole.
    """
    held = df.count()
    if held <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(HASH_RANGE)) < int(HASH_RANGE * (rows / held)))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Apply a kernel to every Arrow batch, in slices of ``KERNEL_ROWS``; a slice in, a batch out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, KERNEL_ROWS):
                yield kernel(batch.slice(start, KERNEL_ROWS))

    return df.mapInArrow(ending(run), schema)


def record(**columns) -> pa.RecordBatch:
    """A batch from named arrays or (values, type) pairs."""
    arrays = {name: pa.array(*held) if isinstance(held, tuple) else held for name, held in columns.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def keep_rows(docs: DataFrame, text: str, wanted: Callable[[str | None], bool]) -> DataFrame:
    """The rows, with all their columns, whose text is wanted."""
    place = docs.columns.index(text)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([wanted(t) for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_batches(docs, kernel, docs.schema)
