"""Vectors of a table that can take part in a comparison, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not NULL, not empty and has neither NULL nor non-finite components."""
    v = F.col(column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), kind)
