"""Session construction with the settings every paysift job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # a checkpoint goes when nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 128 << 20) -> dict:
    """Settings sized for a large input (e.g. 100 TB on 1000 executors).

    Shuffle partitions are sized so a partition holds about
    ``target_partition_bytes`` of shuffled data (rounded up to whole waves of
    task slots); AQE then coalesces small ones and splits skewed ones, and its
    skew thresholds are set relative to the same target.
    """
    slots = max(1, executors * cores_per_executor)
    parts = max(slots, -(-input_bytes // target_partition_bytes))
    parts = -(-parts // slots) * slots
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def build_session(master: str | None = None, app: str = "paysift",
                  shuffle_partitions: int | None = None,
                  conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session; ``master`` defaults to ``local[$BENCH_CPUS or *]``."""
    if master is None:
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session; only when it is unset (local runs,
    tests) is a local folder created and registered as the checkpoint dir.
    """
    import uuid

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/paysift/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it is read from the session.  Only when nothing is set (local
    runs and tests) is a local folder created and registered.
    """
    import tempfile

    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base:
        return base
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            # a machine-local folder is invisible to other executors: refuse rather than guess
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        base = tempfile.mkdtemp(prefix="paysift-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # a core setting; registering it on the context below is what counts
            pass
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def materialize(df):
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``: cuts the
    lineage so a small derived table that several branches read is computed
    from the big input once, and survives executor loss.  Never local."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written as Parquet into a fresh folder under ``spark.checkpoint.dir`` and read back: like ``materialize``, but packed by
    columns, and a reader loads only those that it needs."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
