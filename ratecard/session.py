"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


# Cluster sizing: start every shuffle wide and let AQE coalesce towards
# ~128 MB partitions, so a 100 TB stage never runs with too few (spilling)
# partitions while small stages collapse; scans split at 256 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "4096",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
}


def get_session(
    master: str | None = None,
    app_name: str = "ratecard",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
    cluster: bool = False,
) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    AQE is on so shuffle partitions coalesce at runtime and skewed join
    partitions split; the session time zone is UTC so DATE/TIMESTAMP
    arithmetic matches the SQL oracle; the UI server stays off.
    ``cluster=True`` adds ``CLUSTER_CONF`` (wide shuffles, coalesced by AQE).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only when it is unset (local tests) do we create a private
    scratch folder, so lineage cutting via ``DataFrame.checkpoint`` works.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors "
                           "share; a machine-local folder would lose rows on a cluster")
    local = tempfile.mkdtemp(prefix="ratecard-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present in practice
        return spark.sparkContext.defaultParallelism


@contextmanager
def small_splits(spark: SparkSession, size: int):
    """Files are read in splits of at most ``size`` bytes meanwhile (or as set, if that is less)."""
    name = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, min(size, int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(was))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def freeze(df, bucket_col: str | None = None, n_buckets: int | None = None):
    """Materialise ``df`` as parquet under the reliable checkpoint folder and
    read it back: one job, lineage cut, and every later consumer (or retry)
    sees exactly the same rows -- including columns computed from
    non-deterministic expressions such as ``spark_partition_id``.

    With ``bucket_col`` the copy is written as a bucketed table on that
    column, so later windows / aggregations partitioned by it read it
    without another shuffle."""
    spark = df.sparkSession
    name = f"ratecard_frozen_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    if bucket_col is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    (df.write.mode("overwrite").format("parquet").bucketBy(n_buckets, bucket_col)
     .option("path", path).saveAsTable(name))
    frozen = spark.table(name)
    # the frame knows its files and buckets; the catalog need not keep the
    # (external) table, and dropping it leaves the files alone
    spark.sql(f"DROP TABLE {name}")
    return frozen
