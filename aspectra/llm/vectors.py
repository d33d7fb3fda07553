"""Vectors of an array column as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, vectors: pa.Array):
    """(ids, matrix) per dimension for the rows whose vector has no null, only finite components
    and at least one of them; the ids of rows are kept as int64."""
    ok = np.array(vectors.is_valid()) & np.array(ids.is_valid())
    keep = np.flatnonzero(ok)
    v, i = vectors.take(pa.array(keep)), ids.take(pa.array(keep)).to_numpy(zero_copy_only=False)
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    flat = v.flatten()
    bad = ~np.array(flat.is_valid())
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        if d == 0:
            continue
        rows = np.flatnonzero(size == d)
        at = starts[rows][:, None] + np.arange(d)[None, :]
        x = values[at]
        good = np.isfinite(x).all(1) & ~bad[at].any(1)
        if good.any():
            yield i[rows[good]].astype(np.int64), x[good]
