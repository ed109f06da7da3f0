"""Arrow batches as Python workers take them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that a worker holds as Python objects at once. Spark sends batches of 10,000, whose rows would else all be objects together.
ROWS = 256


def few(batches: Iterable[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most."""
    rows = rows or ROWS
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
