"""What a Spark session needs to run the engine's Python code on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once for each context, so that it need not be installed there."""
    sc = spark.sparkContext
    if not getattr(sc, "_rivulet_sent", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="rivulet-")) / "rivulet-sources.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._rivulet_sent = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set only where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = tempfile.mkdtemp(prefix="rivulet-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/rivulet/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is overwritten, so a retried job never mixes with an old one."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark knows, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this application has written into the shared folder; results that read it are lost with it."""
    remove(spark, own_dir(spark))
