"""Session helpers: building a local session for tests/bench, and cutting lineage.

On a cluster the session is created by the caller; nothing here overrides
cluster settings.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session and only invents a local folder when running in local mode.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "msgscope") -> SparkSession:
    """A local session configured like the test and bench harness."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.msgscope.inputPartitions", str(2 * cores) if isinstance(cores, int) else "16")
        .config("spark.driver.memory", os.environ.get("MSGSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application: its functions run
    there, and a worker's path need not hold it."""
    sc = spark.sparkContext
    if getattr(sc, "_msgscope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    where = tempfile.mkdtemp(prefix="msgscope-")
    kept = os.path.join(where, "package", "msgscope")
    shutil.copytree(root, kept, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(where, "msgscope"), "zip", os.path.dirname(kept)))
    sc._msgscope_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when it is unset *and* the master is local (tests, bench) a fresh
    scratch folder is created; on a cluster an unset value is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="msgscope-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and pins the result (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
