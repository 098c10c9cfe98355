"""Streaming helpers for Arrow functions: batches stay small, groups of a sorted partition come whole."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of a partition sorted by them; only one run is held at a time.

    A run is as large as its group, so callers bound their groups.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        if held:
            last = held[-1]
            if any(last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() != c[0].as_py() for k, c in zip(keys, columns)):
                yield pa.Table.from_batches(held)
                held = []
        changed = None
        for c in columns:
            step = pa.compute.fill_null(pa.compute.not_equal(c.slice(1), c.slice(0, n - 1)), True) if n > 1 else pa.array([], pa.bool_())
            changed = step if changed is None else pa.compute.or_(changed, step)
        ends = [i + 1 for i, x in enumerate(changed.to_pylist()) if x]
        start = 0
        for end in ends:
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held, start = [], end
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def together(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that size, where batches of a row or a few would cost more than their rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: texts become Python objects a few at a time.

    When the task ends, memory it has freed goes back to the system, as workers and their heaps outlive it.
    """
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
    finally:
        pa.default_memory_pool().release_unused()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
