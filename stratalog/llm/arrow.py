"""Reading text columns of Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that are worked on at once; a single longer text is a piece of its own.
PIECE = 1 << 18


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only these become Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(values: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold about PIECE bytes each."""
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)
