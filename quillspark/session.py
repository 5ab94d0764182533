"""A local session for tests and benchmarks; on a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g", **more: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": memory, "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    } | more
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("quillspark").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
