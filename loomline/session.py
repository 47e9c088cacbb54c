"""Spark session factory and settings every entry point shares."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike. Partition counts are left to
#: AQE (initial partitions are coalesced at run time), sizes to the cluster's defaults.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpoints go with the tables that made them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python path on every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="loomline-") as folder:  # the driver's; Spark takes its own copy
        archive = os.path.join(folder, f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        kept = os.path.join(SparkFiles.getRootDirectory(), f"{root.name}-{sc.applicationId}.zip")
        shutil.copyfile(archive, kept)
    sc.addPyFile(kept)
    _shipped.add(sc.applicationId)


def get_spark(app: str = "loomline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the shared settings; `conf` keys use `__` for dots and win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own, `spark.checkpoint.dir`, or (tests only) a temporary one.

    On a cluster the setting names a folder all executors share. Only a local master, where driver
    and executors are one process, gets a machine-local folder.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="loomline-checkpoint-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(configured)
    return configured
