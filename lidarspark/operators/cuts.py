"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` as computed once, written to the checkpoint folder.

    What follows neither repeats its work nor is folded into its expressions. The folder is the
    one named in ``spark.checkpoint.dir``. Where that is unset, a local master makes its own
    folder; a cluster, whose executors couldn't see it, is refused.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; see :func:`cut`."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cuts-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for a table that is written and read again, in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what the session has cut and put into scratch tables so far; what was made from it can't be read again.

    For the end of a job. Within one, ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark
    delete cuts that nothing refers to.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        system.delete(status.getPath(), True)
