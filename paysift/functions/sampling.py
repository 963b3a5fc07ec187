"""Deterministic hashing for splits and samples (partitioning-independent)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(col: Column, modulus: int, salt: str = "") -> Column:
    """``int(md5(salt || key)[:7], 16) % modulus`` — same value in DuckDB."""
    h = F.md5(F.concat(F.lit(salt), col.cast("string")))
    return (F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % F.lit(modulus))


def hash_split(col: Column, train_fraction: float = 0.8, salt: str = "") -> Column:
    """``'train'`` / ``'test'`` by an md5 bucket in 0..9 (80/20 by default)."""
    return F.when(hash_bucket(col, 10, salt) < int(round(train_fraction * 10)), F.lit("train")) \
            .otherwise(F.lit("test"))
