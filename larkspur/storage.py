"""The shared folder: intermediate tables that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Folders made here, by application; Spark does not let a running session set spark.checkpoint.dir.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset (local runs) one of this machine is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN[application] = "file://" + tempfile.mkdtemp(prefix="larkspur-")
            spark.sparkContext.setCheckpointDir(_OWN[application])
        base = _OWN[application]
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes intermediate tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables below the shared folder, once the results that read them are written."""
    remove(spark, f"{shared_dir(spark)}/larkspur")
