"""Numbering, top rows of groups and null-safe joins.

``row_numbers`` range-partitions the rows in a total order, so that no task holds them all; order statistics
of groups are in ``selection``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir`` (survives
    executor loss; never a local checkpoint)."""
    from paysift.session import materialize
    return materialize(df)


def row_numbers(df: DataFrame, order_cols: Sequence[str], name: str = "row_num",
                num_partitions: int | None = None, total_name: str | None = None) -> DataFrame:
    """Consecutive 1-based numbers following ``order_cols`` (nulls first); every row
    gets one, also rows with null or equal order values, which are numbered next to
    each other.

    The input is written once, since the range partitioner samples it in a job of its own.  Rows are then
    range-partitioned by the order columns and a hash of the whole row, so equal keys spread too, sorted, and
    written once with their place in their partition; the partitions' offsets, one row each, are added to
    it.  No single-partition window over the rows and no join on the order columns.
    """
    n = _partitions(df, num_partitions)
    order_cols = list(order_cols)
    df = _materialize(df)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, (MapType, VariantType))])
    # Range bounds come from a sample, so two evaluations of the exchange can
    # cut the data differently; the places are made once and checkpointed.
    s = _materialize(df.withColumn("_tie", tie).repartitionByRange(n, *order_cols, "_tie").sortWithinPartitions(*order_cols, "_tie")
                       .drop("_tie").withColumn("_mid", F.monotonically_increasing_id()))
    s = (s.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
          .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        F.col("_pid").alias("_opid"),
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_total"))
    num = s.join(F.broadcast(offsets), s["_pid"] == offsets["_opid"]).withColumn(name, F.col("_offset") + F.col("_pos") + 1)
    num = num.drop("_mid", "_pid", "_opid", "_pos", "_offset")
    return num.withColumnRenamed("_total", total_name) if total_name else num.drop("_total")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    n: int, name: str = "rank") -> DataFrame:
    """Exactly the first ``n`` rows of every group under ``order`` (a total order).

    One shuffle: Spark puts a group limit before the exchange, so each task
    sends at most ``n`` rows of any group, however large the group is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join on ``keys`` keeping one copy of each key column."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
