"""Vectors of the embedding operators: which rows take part, and their integer entries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries times a scale beyond this are no numbers here: they would not fit the integers.
LARGEST = float(1 << 52)


def fit_vectors(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has entries, none null or not finite, and as many as most rows have
    (of equally many, the larger number); and that number, 0 for a table without any."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = rows.filter(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    sizes = rows.groupBy(F.size(x).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0] or 0
    return rows.filter(F.size(x) == most), most


def whole(column: pa.Array, d: int, scale: float) -> np.ndarray:
    """floor(scale * entry) of an array column without nulls, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * scale).reshape(-1, d)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"entries beyond {LARGEST / scale:g}")
    return x
