"""Array work that the built-in functions can only do in quadratic time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_sums(numbers: pa.Array) -> pa.Array:
    """Running sums inside each array, worked out over a whole Arrow batch at once."""
    numbers = numbers.cast(pa.list_(pa.int32()))
    sizes = numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(numbers.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    before = np.concatenate([[0], total])[offsets[:-1]]
    sums = pa.array((total - np.repeat(before, sizes)).astype(np.int32))
    missing = pa.array(numbers.is_null().to_numpy(zero_copy_only=False)) if numbers.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), sums, mask=missing)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def halved_sums(numbers: pa.Array) -> pa.Array:
    """Each number averaged with what its predecessor became; the first stays. Arrays of a batch are folded side by side."""
    numbers = numbers.cast(pa.list_(pa.float64()))
    sizes = numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = numbers.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).copy()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for place in range(1, int(sizes.max(initial=0))):
        at = offsets[:-1][sizes > place] + place
        out[at] = (out[at] + out[at - 1]) / 2
    missing = pa.array(numbers.is_null().to_numpy(zero_copy_only=False)) if numbers.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out), mask=missing)
