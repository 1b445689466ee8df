"""Session helpers: durable lineage cuts and plan settings that hold on a cluster."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary one is made only where none is configured and everything runs on this machine; a cluster must name one,
    since its machines could not write to a folder of the driver together.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="tallyfold-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint that survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet under the checkpoint folder, with ``options`` of the writer, and read back.

    Like ``cut``, but columnar: later readers scan only the columns and rows they need, and nothing is computed twice.
    The files live as long as the session's checkpoint folder.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing will read again."""
    files = df.inputFiles()
    if files:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the tables that are stored inside; they are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sent_by_value(module: str) -> None:
    """Let Arrow functions of ``module`` travel to the executors whole, where this package need not be installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
