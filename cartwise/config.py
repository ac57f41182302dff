"""Session settings and the shared checkpoint folder.

On a cluster the session comes from spark-submit and already names
``spark.checkpoint.dir`` (a shared folder); the library only reads it.
``ensure_checkpoint_dir`` makes one up only for a ``local`` master, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are written against. Session time zone UTC keeps
# epoch <-> timestamp conversions stable; AQE coalesces small shuffles,
# splits skewed join partitions and turns small joins into broadcasts
# only after measuring the real size at runtime.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "cartwise",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    ``master`` is left to the environment when None (spark-submit sets it).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(largest_shuffle_bytes: int, total_cores: int,
               target_partition_bytes: int = 128 * 1024 * 1024,
               scan_split_bytes: int = 256 * 1024 * 1024) -> dict:
    """Partition sizing for a cluster run, to pass to spark-submit.

    ``largest_shuffle_bytes`` is the biggest shuffle of the job - for the
    intent job the projected event rows going into the session join (about
    40 bytes a row), not the raw input. The initial shuffle partition count
    puts that shuffle near ``target_partition_bytes`` per task (and at least
    three waves of the cluster's cores); AQE coalesces smaller shuffles to the
    advisory size and splits skewed join partitions, so each task's working
    set stays within executor memory and spills rather than fails.
    """
    by_size = -(-int(largest_shuffle_bytes) // int(target_partition_bytes))
    parts = max(3 * int(total_cores), by_size)
    return {
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder as the session's configuration names it,
    the same in every application; without one, the folder set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)   # Spark's own checkpoints, in a folder of this application
    return named or spark.sparkContext.getCheckpointDir() or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is configured, a
    ``local`` master gets a temporary one; any other master is refused, since
    a folder of one machine is not seen by the others."""
    d = checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share "
                           f"(master {master} has none)")
    spark.sparkContext.setCheckpointDir(
        tempfile.mkdtemp(prefix="cartwise-ckpt-", dir=os.environ.get("CARTWISE_SCRATCH", "/tmp")))
    return spark.sparkContext.getCheckpointDir()
