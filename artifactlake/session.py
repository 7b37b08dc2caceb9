"""Session helpers: a tuned local session and lineage cuts that outlive executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, app: str = "artifactlake") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder the session names in ``spark.checkpoint.dir``; a local one only where unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = sc.getConf().get("spark.checkpoint.dir", None)
        one_machine = sc.master == "local" or sc.master.startswith("local[")
        if current is None and not one_machine:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if current is None:
            current = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        sc.setCheckpointDir(current)
    return current


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
