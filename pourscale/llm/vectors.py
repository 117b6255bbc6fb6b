"""Vectors as the search operators take them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and vector (array of double), a row for each id.

    Null ids, null vectors and vectors with null or non-finite components are left out.
    Of several rows with one id the vector that sorts first counts.
    """
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_column).isNotNull() & vector.isNotNull() & finite).groupBy(F.col(id_column).alias("id")).agg(F.min(vector).alias("vector"))


def matrix(vectors, dtype) -> np.ndarray:
    """Vectors of any lengths as rows; missing components are 0."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out
