"""Session helpers: settings that suit the engine, table access, the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", app: str = "scholium", **conf: str) -> SparkSession:
    """A session for tests and local runs; on a cluster, spark-submit's own settings are used instead."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir where set, else one of our own (single-machine sessions only).

    A folder of our own is removed when the process ends; what lies in a shared one is removed by release() or by its owner.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return shared or current.get()
    if not shared:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"scholium-checkpoints-{os.getpid()}")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)
    return shared


#: Estimated bytes from which a cut's estimate is dropped: nothing that large is broadcast, so nothing is lost.
ESTIMATED = 1 << 40


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files: short lineage that survives lost executors.

    A checkpoint keeps the estimated size of its plan, and joins multiply estimates: in a loop the number of digits doubles each
    round, until the driver holds and multiplies numbers of megabytes. From ESTIMATED on Spark's default takes its place.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    ran = done._jdf.queryExecution()
    if not ran.optimizedPlan().stats().sizeInBytes() > ESTIMATED:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(ran.toRdd(), done._jdf.schema(), False), spark)


_STAGED: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Like cut(), as a parquet table in the shared folder: columnar, prunable, read again without recomputing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.parquet(path)


def release() -> int:
    """Remove the tables that stage() has written; call it when no result that reads them is needed any more."""
    removed = 0
    while _STAGED:
        spark, path = _STAGED.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return removed
