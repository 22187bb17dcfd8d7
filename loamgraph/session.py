"""Session helpers: local sessions for tests and bench, and lineage cuts in the shared folder."""

from __future__ import annotations

import gc
import tempfile

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "loamgraph") -> SparkSession:
    """A local session with the settings that the engine expects of a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a private one is set only where none is named and the master is
    local (tests). Elsewhere a machine's own folder would lose data with the machine, so that is an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="loamgraph-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage; a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """The results of steps that do not depend on each other and start jobs of their own; the jobs run side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def released(spark: SparkSession) -> None:
    """Lets the driver collect its garbage between the steps of a long query: only then Spark deletes the shuffle and checkpoint
    files that nothing reads any more, and unloads the code of plans that have run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
