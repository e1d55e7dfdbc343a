"""A session with the settings that the package's queries expect, for scripts and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "veilspark", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Local session: UTC, adaptive execution, Arrow. On a cluster, use the cluster's own session instead."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.driver.memory", "6g")
        .config("spark.driver.extraJavaOptions", "-Djava.net.preferIPv4Stack=true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables below ``sf_dir`` (any path that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
