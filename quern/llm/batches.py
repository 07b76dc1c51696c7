"""Arrow batches in parts of bounded size, so that a worker never holds more than a few texts as Python objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer text is a part of its own.
SLICE = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose values in a string or binary column take about ``size`` bytes."""
    for b in batches:
        begin, total = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if i > begin and total + n > size:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if b.num_rows > begin:
            yield b.slice(begin)
