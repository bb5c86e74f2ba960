"""SparkSession construction and the settings every plan relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that are semantic (time zone) or that the plans count on (adaptive execution, skew splitting).
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, memory: str = "4g", **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session to every operator."""
    builder = SparkSession.builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("saltmarsh")
    for key, value in {**CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
