"""Which vectors take part, and classes of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, has no null, infinite or NaN component, and isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vector, class: a 64-bit hash of the vector, null for one that takes no part."""
    clean = F.transform(vector, lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast("double"))  # -0 is 0
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), F.when(usable(F.col(vector)), F.xxhash64(clean)).alias("class"))


def stacked(column: pa.Array) -> np.ndarray:
    """A matrix from a list column whose lists have equal lengths and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
