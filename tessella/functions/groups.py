"""Batches of whole groups, for tasks whose rows of a group follow one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Each value as its place among the distinct ones in order, and these; strings in order of their characters, null first."""
    coded = column.dictionary_encode(null_encoding="encode")
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda k: (names[k] is not None, names[k]))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], [names[k] for k in order]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that cut no run of equal ``key``; a run is held until it ends."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    for batch in batches:
        if not len(batch):
            continue
        at, _ = codes(batch.column(key))
        ends = np.flatnonzero(np.diff(at)) + 1
        if held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
            ends = np.concatenate(([0], ends))
        if len(ends):
            last = int(ends[-1])
            yield from joined([*held, *([batch.slice(0, last)] if last else [])])
            held, batch = [], batch.slice(last)
        held.append(batch)
    yield from joined(held)
