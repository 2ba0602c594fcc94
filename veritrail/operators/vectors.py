"""What the vector searches share: which vectors can be compared, and their unit matrices by dimension."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def comparable(vector: str) -> Column:
    """Vectors with components, all of them there and finite; others take no part in a search."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero vector is like nothing."""
    matrix = matrix.astype("float64")
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def by_dimension(vectors: Iterable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (positions, unit vectors as rows)}; only vectors of one dimension are ever compared."""
    rows = list(vectors)
    sizes = np.fromiter((len(v) for v in rows), int, len(rows))
    return {int(d): (at := np.flatnonzero(sizes == d), unit(np.stack([rows[i] for i in at]))) for d in np.unique(sizes)}
