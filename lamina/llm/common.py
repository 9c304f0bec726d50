"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import tempfile

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(name: str) -> None:
    """Send the functions of module `name` to executors by value: they need no copy of this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def few(batches, rows: int = 512):
    """Batches of at most `rows` rows, so that what Python makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of one Arrow batch, unless the session sets its own: what JVM and Python hold of a batch doesn't follow the length of texts.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def tidy(run):
    """A function for mapInArrow, whose worker gives memory back to the system at the end of a task, as it may idle long."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: the one that the cluster names in spark.checkpoint.dir.

    A folder of our own is set only in local mode, as in tests; on a cluster that names none this is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamina-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slim(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """cut() for narrow tables, in one file for each `rows` rows: a small table makes few files and few tasks."""
    held = df.persist()
    out = cut(held.coalesce(max(1, -(-held.count() // rows))))
    held.unpersist()
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge.

    Alternating large-star and small-star: every round is joins and partial aggregates
    over the edge list, so no component is gathered in one task or the driver, and the
    number of rounds grows with the logarithm of a component's size. The table of least
    neighbours is broadcast while the edges are known to be no more than broadcast_rows,
    else joined by a shuffle. Null ends and self loops are ignored; repeated edges count
    once; no edges give no rows.
    """
    e = slim(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while True:
        hint = F.broadcast if e.limit(broadcast_rows + 1).count() <= broadcast_rows else lambda df: df
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: larger neighbours of u hang on the least of u's neighbourhood
        large = both.join(hint(low), both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        # small star: smaller neighbours of u and u itself hang on the least of them
        step = large.join(hint(least), large.u == least.k)
        small = step.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(step.select("u", F.col("m").alias("v")))
        e = slim(small.where("u > v").distinct())
        # Done when it is a set of stars: each leaf has one centre, and no node is both a leaf and a centre.
        n = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if n.n == n.d and not e.select("u").join(hint(e.select(F.col("v").alias("u"))), "u", "left_semi").limit(1).count():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
