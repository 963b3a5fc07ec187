"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 4


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column for a stable cross-engine comparison."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def sql_str(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def sql_case(expr: str, mapping: Mapping, default: str = "NULL") -> str:
    """``CASE expr WHEN k THEN v ... ELSE default END`` from a fixed-value table."""
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def sql_round(expr: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits})"
