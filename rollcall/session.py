"""Session helpers: the settings every operator in this package assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# All time buckets (hour, weekday, calendar date) are UTC.
SESSION_ZONE = "UTC"


def build_session(master: str | None = None, app: str = "rollcall",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or fetch) a session with UTC time, AQE and no web UI."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": SESSION_ZONE,
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def cluster_settings(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the bytes a job reads.

    Shuffle partitions are set so each holds about ``target_partition_bytes``
    before AQE coalesces small ones (never fewer than 2x the cores); scans are
    split at the same size; AQE splits skewed join partitions.
    """
    parts = max(2 * int(cores), int(input_bytes) // int(target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def configure(spark: SparkSession) -> None:
    """Settings for sessions this package creates or is handed.

    The operators themselves do not depend on the session: UTC buckets are
    epoch arithmetic and writers pass their own options.  Only displayed
    timestamps (``show()`` of event-time columns) follow the session zone,
    which is pinned to UTC here.
    """
    spark.conf.set("spark.sql.session.timeZone", SESSION_ZONE)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    This is whatever ``spark.checkpoint.dir`` names (a shared file system on a
    cluster).  Only a local-mode session without that setting, as in tests,
    gets a scratch folder of its own; on a cluster the setting is required.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        current = tempfile.mkdtemp(prefix="rollcall-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:  # a classic session also gets the RDD checkpoint folder; a remote one has none to set
        sc = spark.sparkContext
    except Exception:
        sc = None
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current
