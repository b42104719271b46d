"""Arrow batches in short pieces, so that a Python stage holds little more than its input."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text or body in a piece; a longer row is a piece of its own.
PIECE_BYTES = 2 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of about `most` bytes of one column.

    The session decides how many rows a batch has, by default ten thousand; as Python
    objects these take several times their bytes.
    """
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for start, end in zip([0, *ends], [*ends, b.num_rows]):
            yield b.slice(start, end - start)
