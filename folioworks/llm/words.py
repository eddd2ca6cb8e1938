"""Words of whole texts as Arrow arrays: maximal runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges (from, number) of a batch that hold about ``size`` bytes of text each; a longer text is a range of its own."""
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    ends = np.cumsum(length)
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right")))
        yield at, until - at
        at = until


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after the other, number of words of each text); no text may be null."""
    parts = pc.ascii_split_whitespace(texts)
    values, bounds = parts.flatten(), np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), out=bounds[1:])
    real = pc.not_equal(pc.binary_length(values), 0)
    before = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(real.to_numpy(zero_copy_only=False), out=before[1:])
    return values.filter(real), np.diff(before[bounds])
