"""A local session with the settings that tests and benchmarks use."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", memory: str = "12g") -> SparkSession:
    """Adaptive execution, UTC, as many shuffle partitions as cores, and small scan splits so that small files use all cores."""
    n = str(cpus) if str(cpus).isdigit() else "8"
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": n,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.files.openCostInBytes": "256k",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("quillspark").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
