"""Session helpers shared by the whole library."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch, where the session has not set another number: texts may be long, and a batch is held whole.
BATCH_ROWS = "500"
#: Rows of a small side that may be broadcast; a larger one is joined by its keys.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is set, a local session takes one of its own; on a cluster that would be lost with its machine, and is an error."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "gridloom-checkpoints"))
    return given or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: its lineage ends."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark deletes the files of a shuffle (and of a checkpoint, where it is set to) once nothing on the driver refers to them, which a driver with memory to spare may not find out until the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few rows, which are counted; meant for narrow rows that are cheap to count, as after cut()."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
