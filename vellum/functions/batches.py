"""Parts of Arrow batches whose rows become Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows, and bytes of them, that are Python objects at a time.
ROWS, BYTES = 64, 1 << 20


def slices(rows: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """Parts of a column or batch of at most ROWS rows and about BYTES bytes; one row at least."""
    lo = 0
    while lo < len(rows):
        n = min(ROWS, len(rows) - lo)
        while n > 1 and rows.slice(lo, n).nbytes > BYTES:
            n //= 2
        yield rows.slice(lo, n)
        lo += n
