"""Session helpers: a local session for tests and the shared checkpoint folder of a cluster."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    os.environ.setdefault("PYTHONHASHSEED", "0")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=conf)
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one is made only where it is unset and the session is local
    (tests): on a cluster the tasks could not read it, so that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)



def spread(scan: DataFrame) -> DataFrame:
    """A scan, dealt anew where it has far fewer parts than the cluster has cores (a small table in one file), as what
    follows is work for the CPU; a scan of many files is left as it is. For scans only: their parts are known unrun."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() * 4 <= cores else scan


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more: it learns of them when the
    driver collects its garbage, which a driver with room to spare does too late for the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
