"""Arrow batches in pieces of bounded size.

Spark bounds an Arrow batch by rows, not by bytes, so a batch of long texts can
be of any size.  ``pieces`` cuts it where the bytes of one column reach a
bound; a text that is longer than the bound is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into Python objects at a time.
PIECE = 4 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: str | int = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, at most about ``limit`` bytes of
    ``column`` (a string or binary one) in each."""
    for batch in batches:
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' bytes; a null text is empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
