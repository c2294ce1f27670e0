"""Rows from arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is computed once, however often ``body`` names it, also inside its own lambdas.

    ``get`` would ask for its array's type, and so whether any part of ``body`` may be null, again at each row; ``element_at`` asks once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _summed(sizes: pa.Array) -> pa.Array:
    n, flat = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64), sizes.flatten()
    first = np.cumsum(n) - n

    def before(x: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(x)])
        return at[:-1] - np.repeat(at[first], n)

    sums = before(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    unknown = before(flat.is_null().to_numpy(zero_copy_only=False).astype(np.int64)) > 0
    return pa.ListArray.from_arrays(pa.array(np.append(first, n.sum()), pa.int32()), pa.array(sums, pa.int64(), mask=unknown), mask=sizes.is_null())


def sums_before(sizes: Column) -> Column:
    """For each place of an array of numbers the sum of those before it (null after a null one); only the numbers go to Python, a batch at once. Not inside lambdas."""
    return F.arrow_udf(_summed, "array<bigint>")(sizes.cast("array<bigint>"))


def opened(rows: DataFrame, keep: tuple[str | Column, ...], array: Column | str, element: str, at: str | None = None) -> DataFrame:
    """``keep``, the place (from 0) as ``at``, and ``element``: a row for each element of an array.

    An inner explode makes the optimizer infer a filter on the array's size, which holds a second copy of all that computes the
    array and runs before it; from an outer one nothing is inferred, and the rows of empty arrays are dropped after it.
    """
    found = rows.select(*keep, F.posexplode_outer(array).alias(at or "_at", element)).where(F.col(at or "_at").isNotNull())
    return found if at else found.drop("_at")
