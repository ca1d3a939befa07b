"""Session helpers.

Library code never changes session settings; these helpers exist for tests,
``bench.py`` and users who start their own session.  On a cluster the
operator passes the same settings through ``spark-submit --conf``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the plans are designed around.  AQE re-plans joins from runtime
# sizes (a sort-merge join becomes a broadcast join only when the shuffled
# side really is small), coalesces tiny shuffle partitions and splits skewed
# join partitions, which is what keeps a hot customer, restaurant or order
# from landing in a single task.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app_name: str = "tiffin",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """A ``local[cores]`` session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # catalog tables of a local run go to a scratch folder, not the cwd
    conf["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="tiffin-warehouse-")
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``
    (or the scratch folder a test session was given instead)."""
    try:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # Spark Connect sessions have no SparkContext
        value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        value = spark.conf.get(_LOCAL_KEY, None)
    return value or None


_LOCAL_KEY = "tiffin.local.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the checkpoint folder that the user set or configured; only when there is none
    *and* the session is local (a test run) create a private scratch folder.
    On a cluster a machine-local folder would be invisible to the executors,
    so a missing ``spark.checkpoint.dir`` is an error there."""
    root = checkpoint_root(spark)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        if root is None:
            raise RuntimeError("set spark.checkpoint.dir on the Spark Connect server") from None
        return root
    if sc.getCheckpointDir() is not None:
        # Spark appends a folder of its own to what the user set
        return sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="tiffin-ckpt-")
        spark.conf.set(_LOCAL_KEY, root)
    sc.setCheckpointDir(root)
    return root


def cluster_conf(
    largest_shuffle_bytes: int,
    total_cores: int,
    target_partition_bytes: int = 256 * 1024**2,
) -> dict[str, str]:
    """Settings for a cluster run, sized from the largest expected shuffle.

    For these jobs the largest shuffle is deliveries' order ids (plus a
    count) in Q5/Q9/Q11 and the key audit; at 100 TB of input it is a few
    TB.  Shuffle partitions are sized so one partition is about
    ``target_partition_bytes`` (fits an executor core's memory share and
    spills gracefully), rounded up to a multiple of the core count so waves
    are full; AQE then coalesces the many small shuffles of the aggregated
    stages and splits skewed join partitions.
    """
    partitions = max(total_cores, -(-largest_shuffle_bytes // target_partition_bytes))
    partitions = -(-partitions // total_cores) * total_cores
    return {
        **{k: v for k, v in RECOMMENDED_CONF.items() if k != "spark.ui.enabled"},
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(512 * 1024**2),
        "spark.sql.parquet.filterPushdown": "true",
    }
