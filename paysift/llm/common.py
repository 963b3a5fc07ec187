"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.session import shared_dir

#: A side of a join is broadcast only when its measured size is proven to be at most this.
BROADCAST_BYTES = 48 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: whole texts travel in them, and some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, so that several
    readers share one computation and a lost executor costs no recomputation of it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, width: Column | int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its rows, of ``width`` bytes each,
    are measured to fit ``BROADCAST_BYTES``; else as it is, for a shuffled join that
    adaptive execution splits where a key is hot.  Both ways give the same rows."""
    width = F.lit(width) if isinstance(width, int) else width
    size = df.agg(F.sum((width + F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one made of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` does just that to a text without other letters."""
    return (F.when(F.length(col) == F.octet_length(col), F.lower(col))
            .otherwise(F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())))
