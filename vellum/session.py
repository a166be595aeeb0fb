"""Session defaults for local runs and the checkpoint folder shared by all executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    defaults = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        # small tables still use every core
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("VELLUM_DRIVER_MEMORY", "12g"),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=defaults | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder of checkpoints where none is set: the one that spark.checkpoint.dir names; on a local master, where
    driver and executors are one process, a temporary one that is removed at exit. A cluster must name a shared folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vellum-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir. Files of
    checkpoints that no plan uses any more are removed where spark.cleaner.referenceTracking.cleanCheckpoints is on (it is in
    local_session). Over Spark Connect the checkpoint itself is handed on, as the server sets its folder."""
    spark = df.sparkSession
    if not hasattr(spark, "_jsparkSession"):
        return df.checkpoint(eager)
    _checkpoint_folder(spark)
    done = df.checkpoint(eager)
    # A checkpoint keeps the size estimate of its plan, and joins multiply estimates: in a loop they grow until the driver
    # does nothing but multiply. The same rows as a fresh leaf have the default estimate; the engine measures at run time.
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
