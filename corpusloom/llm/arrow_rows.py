"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import pyarrow as pa

from corpusloom.batching import slices, small_batches

__all__ = ["batch", "slices", "small_batches"]


def batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], list(types))
