"""Session settings under which results are defined."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Time zone and NTZ handling are part of the semantics; the rest lets Spark adapt partitions to the data at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(cpus: int | None = None, memory: str = "12g", **settings: str) -> SparkSession:
    """A local session. On a cluster, make one there and call configured() on it."""
    cpus = cpus or os.cpu_count()
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("larkspur").config("spark.driver.memory", memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", str(cpus))
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configured(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
