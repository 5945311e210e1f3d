"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero and holds finite numbers only, of the length
    that most vectors have (ties: the longer)."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vec_col, lambda x: x != 0)
    good = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & some)
    most = good.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size(vec_col) == (most["n"] if most else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))
