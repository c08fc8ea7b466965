"""Session helpers: local sessions for tests/bench and a shared checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings for a large cluster (~100 TB inputs, ~1000 executors). Apply them when building the session the
# platform gives you; they are not forced by the library.
SCALE_CONF = {
    # AQE re-plans from measured sizes: coalesces small shuffle partitions, splits skewed join partitions,
    # and turns sort-merge joins into broadcasts only when the measured side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Start with many shuffle partitions (about shuffle bytes / 256 MB: ~20 TB of projected window input
    # -> ~80k) and let AQE coalesce; each task then sorts a slice that fits executor memory.
    "spark.sql.shuffle.partitions": "80000",
    # Scan splits of 512 MB of Parquet: ~200k scan tasks for 100 TB, a few waves on 1000 executors.
    "spark.sql.files.maxPartitionBytes": "512m",
    # Keep the static threshold small: explicit broadcasts in this library are bounded by construction.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Large streaming state goes to RocksDB instead of the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.session.timeZone": "UTC",
}
# Skew knobs at that scale (driftwise.params.SkewParams): hot_key_rows=50_000_000 and segment_rows=
# 5_000_000 keep every ordered-window task at a few million rows; global_ordinal segment_rows likewise.


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "driftwise") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session the platform hands you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; a private folder is only created when the session has none and runs
    in local mode (tests, laptops). On a cluster without the setting this fails loudly instead of writing
    to a machine-local folder the executors cannot see.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage: checkpoints and "
                               "stream outputs must be readable by every executor")
        conf_dir = tempfile.mkdtemp(prefix="driftwise-ckpt-")   # local mode only (tests, laptops)
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "driftwise", f"{name}-{uuid.uuid4().hex[:12]}")
