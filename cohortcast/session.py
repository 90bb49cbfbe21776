"""Session helpers: building a local session for tests/bench and resolving the
shared checkpoint directory.

On a cluster the checkpoint directory must be a shared filesystem path; it is read
from ``spark.checkpoint.dir`` (set by the cluster).  Only when nothing is configured
(local tests) do we fall back to a fresh temporary directory.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortcast") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """Application id (also under Spark Connect, where there is no SparkContext)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        return spark.conf.get("spark.app.id", str(id(spark)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, configuring one only when it is unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="cohortcast-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that functions pickled by reference load
    there wherever the session was started."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        sc = None
    if app_id(spark) in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cohortcast-ship-"), "cohortcast.zip")  # served for the whole session
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app_id(spark))


_SHIPPED: set[str] = set()
