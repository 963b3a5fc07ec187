"""File sources and sinks: typed CSV (one scan over a glob), Parquet with
pruning, Parquet-else-CSV fallback, partitioned append logs, JSON documents.

Paths on a cluster must be shared storage; ``paysift.session.shared_dir``
hands out fresh folders under ``spark.checkpoint.dir`` for intermediate
files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str,
             header: bool = True) -> DataFrame:
    """Header CSV with a declared schema: no inference pass over the data.
    ``path`` may be a folder, a glob (``dir/*.csv``) or a list — one scan either way."""
    return (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
                 .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


REJECT_COLUMNS = ["source_file", "line", "reasons"]


def read_csv_checked(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows) of header CSV.

    A line is rejected if it has another number of fields than the schema, or a field that isn't empty and can't be
    cast to its type; it then isn't among the typed rows, whose nulls are thus fields that were empty.  A rejected row is
    ``source_file`` (its name with the folder above), ``line`` (the fields as read, joined by commas; the whole line where their number is wrong) and
    ``reasons``, one for each field at fault.  Both channels are plain scans of the same files.
    """
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    corrupt = "_corrupt_line"
    while corrupt in schema.names:
        corrupt += "_"
    raw = StructType([StructField(f.name, StringType()) for f in schema.fields] + [StructField(corrupt, StringType())])
    lines = (spark.read.schema(raw).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    fields = [F.col(f"`{f.name}`") for f in schema.fields]
    typed = [c.try_cast(f.dataType).alias(f.name) for c, f in zip(fields, schema.fields)]
    faults = F.array_compact(F.array(*[
        F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(), F.lit(f"{f.name}: not a {f.dataType.simpleString()}")) for c, f in zip(fields, schema.fields)]))
    reasons = F.when(F.col(corrupt).isNotNull(), F.array(F.lit("wrong number of fields"))).otherwise(faults)
    checked = lines.select("*", F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("source_file"), reasons.alias("reasons"))
    line = F.coalesce(F.col(corrupt), F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in fields]))
    return (checked.where(F.size("reasons") == 0).select(*typed),
            checked.where(F.size("reasons") > 0).select("source_file", line.alias("line"), "reasons"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV (UTF-8, no byte-order mark, no index column)."""
    (df.write.mode(mode).option("header", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] = (), files_per_partition: int = 8, touched_only: bool = False) -> str:
    """Parquet; with ``partition_by`` the rows are dealt by it and a salt first, so that each
    folder gets at most ``files_per_partition`` files and a hot one is written by several tasks.
    With ``touched_only`` an overwrite replaces only the partitions that ``df`` has rows of; the others stay."""
    if partition_by:
        writer = _clustered(df, partition_by, files_per_partition).write.mode(mode).partitionBy(*partition_by)
        writer.option("partitionOverwriteMode", "dynamic" if touched_only else "static").parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def _clustered(df: DataFrame, by: Sequence[str], files: int) -> DataFrame:
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
    return df.repartition(*[F.col(c) for c in by], salt)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the session (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_with_fallback(spark: SparkSession, parquet_path: str, csv_path: str, csv_schema: StructType | str,
                       columns: Sequence[str]) -> DataFrame:
    """The cleaned Parquet table when it exists, else the raw CSV projected to
    the same columns (one driver-side existence check, then one reader)."""
    if path_exists(spark, parquet_path):
        return spark.read.parquet(parquet_path).select(*columns)
    return read_csv(spark, csv_path, csv_schema).select(*columns)


def append_log(df: DataFrame, path: str, date_col: str = "created_at") -> str:
    """Append rows to a log table partitioned by day (``log_date``)."""
    return write_parquet(df.withColumn("log_date", F.to_date(date_col)), path, "append", ["log_date"])


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def append_batch(df: DataFrame, path: str, batch: str, date_col: str = "created_at") -> bool:
    """Append a batch of rows to a log, once: whether this call has written it.

    The rows go to the batch's own folder (partitioned by day), then an empty file named after the batch is put into the
    manifest, the one step that makes them part of the log.  A batch that the manifest names is not
    written again; one whose write broke off isn't named, isn't read, and is replaced when the call is repeated.
    A batch has one writer at a time; different batches may be written side by side.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError("a batch is named by letters, digits, dots, dashes and underscores")
    fs, mark, at = _file_system(df.sparkSession, f"{path}/manifest/{batch}")
    if fs.exists(mark):
        return False
    write_parquet(df.withColumn("log_date", F.to_date(date_col)), f"{path}/data/batch={batch}", "overwrite", ["log_date"])
    fs.mkdirs(at(f"{path}/manifest"))
    fs.create(mark, True).close()
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the batches that the manifest names, with ``batch`` and ``log_date``."""
    named = [f"{path}/data/batch={b}" for b in batches(spark, path)]
    if not named:
        raise FileNotFoundError(f"no whole batch in {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*named)


def batches(spark: SparkSession, path: str) -> list[str]:
    """The names in a log's manifest, one for each call that wrote (not data)."""
    fs, folder, _ = _file_system(spark, f"{path}/manifest")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def write_json_docs(df: DataFrame, path: str, doc_col: str = "doc") -> str:
    """One JSON document per row as text lines."""
    df.select(doc_col).write.mode("overwrite").text(path)
    return path
