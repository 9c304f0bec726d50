"""The folder that driver and executors share, and cuts of a lineage in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamina-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again.

    Not a checkpoint, as that keeps the constraints of its plan: these double with each round of a loop of joins.
    """
    to = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def meet(many: DataFrame, few: DataFrame, on: str | Column, small: bool) -> DataFrame:
    """many joined with few, which is broadcast if it is small; else both are shuffled.

    Not left to the planner: it takes sizes from compressed files and knows none of rows made on the driver, so it would
    broadcast the exploded words of all facts to be met by ten queries.
    """
    return many.join(F.broadcast(few), on) if small else many.hint("merge").join(few, on)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any store that Spark reads; None while it is missing."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole, unless it is there: it takes its name when it is complete."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return
    aside = _at(spark, f"{path}.{uuid.uuid4().hex}")[1]
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(aside, p):
        fs.delete(aside, False)
