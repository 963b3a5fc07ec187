"""Column surgery: prefix selection and vector/array flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_by_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = (),
                     invert: bool = False) -> DataFrame:
    """``keep`` columns plus every column starting with ``prefix`` (or not, with ``invert``)."""
    picked = [c for c in df.columns if c not in keep and c.startswith(prefix) != invert]
    return df.select(*keep, *picked)


def vector_to_columns(df: DataFrame, col: str, prefix: str, dim: int,
                      drop: bool = True) -> DataFrame:
    """Array or ML vector column -> ``prefix0..prefix{dim-1}`` double columns."""
    from pyspark.ml.linalg import VectorUDT
    c = F.col(col)
    if isinstance(df.schema[col].dataType, VectorUDT):
        from pyspark.ml.functions import vector_to_array
        c = vector_to_array(c)
    cols = [c[i].cast("double").alias(f"{prefix}{i}") for i in range(dim)]
    rest = [x for x in df.columns if not (drop and x == col)]
    return df.select(*rest, *cols)
