"""Session settings for local runs, and where durable intermediate results go."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Where this package lies.
ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: str = "8", app: str = "stayspark", **conf: str) -> SparkSession:
    """A local session with the settings the jobs expect; a cluster supplies its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Building an expression does not record where in the Python code it was written.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Where results that are read again go: a folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``; where that is unset, as in tests, a folder beside
    the warehouse tables, whatever the master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    Elsewhere it is installed or sent with ``--py-files``, as any package.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage.

    Spark removes the files once the frame is out of use where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as ``local_session`` sets it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


@contextmanager
def scratch_folder(spark: SparkSession, kind: str) -> Iterator[str]:
    """A new folder that driver and executors share, removed at the end; what is needed longer must be made durable before."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def in_rounds(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """For loops in which each stored result is joined to make the next one: gives what stores a result.

    A checkpoint keeps the planner's guess of its size, which joins square, so after some twenty rounds it is a number
    of a million digits.  Here results are written as Parquet to the shared folder and read again with their true size.  All of
    them are removed at the end; what is needed longer must be made durable before.
    """
    number = count()
    with scratch_folder(spark, "rounds") as folder:

        def store(df: DataFrame) -> DataFrame:
            path = f"{folder}/{next(number)}"
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        yield store
