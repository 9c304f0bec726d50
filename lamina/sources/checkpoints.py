"""Checkpoints of agents' threads: one row for each thread, put, read and listed by key.

Rows lie in buckets by the crc32 of their thread, each bucket a table of the versioned state. A put brings its own rows
to one a thread, merges them with the buckets they fall in and writes these in one job; the files of all other
buckets stay as they are, so a put costs what its buckets hold and a get reads the buckets of its threads. Two puts in
different buckets both land; of two in one bucket the slower is merged again on top of the faster.

The later put replaces a thread's row, whatever its time. Within one put the row with the newest (created_at, content)
stays (or by another order), nulls being least; a null thread is the thread `default`. Columns beyond thread, created_at and content
are left out. A put without rows changes nothing. A repeated put gives the same rows, so micro-batches may be replayed.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut
from .state import State

CHECKPOINT = T.StructType([T.StructField("thread", T.StringType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("content", T.StringType())])
PREFIX = "checkpoint:"
SNAPSHOT = "values string, next array<string>, metadata string, parent_config string, tasks array<string>"


def content(values: Column, next: Column, metadata: Column, parent_config: Column | None = None, tasks: Column | None = None) -> Column:
    """The JSON text of a checkpoint; values, metadata and parent_config are structs or maps."""
    parts = {"values": values, "next": next, "metadata": metadata, "parent_config": parent_config, "tasks": tasks}
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items() if c is not None]))


def snapshots(rows: DataFrame) -> DataFrame:
    """(thread, created_at, values, next, metadata, parent_config, tasks) of every row whose content is a JSON object; absent parts are empty, an absent parent is null."""
    good = rows.where(F.schema_of_variant(F.try_parse_json("content")).startswith("OBJECT"))
    x = good.select("thread", "created_at", F.from_json("content", SNAPSHOT).alias("x"))
    part = lambda name, empty: F.coalesce(F.col(f"x.{name}"), empty).alias(name)
    none = F.array().cast("array<string>")
    return x.select("thread", "created_at", part("values", F.lit("{}")), part("next", none), part("metadata", F.lit("{}")), F.col("x.parent_config").alias("parent_config"), part("tasks", none))


class Checkpoints:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, attempts: int = 20):
        """A store in a folder that driver and executors share. The number of buckets holds from the first put on."""
        self.spark, self.state, self.asked = spark, State(spark, path, attempts, tables={}), buckets

    def buckets(self, version: int | None = None) -> int:
        return int(self.state.record(version)["notes"].get("buckets", self.asked))

    def folders(self, version: int | None = None) -> dict[int, str]:
        """{bucket: folder} of the buckets that hold rows."""
        return {int(b): x["parts"][0]["at"] for b, x in self.state.record(version)["tables"].items()}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], CHECKPOINT)
        return self.spark.read.schema(CHECKPOINT).parquet(*[f"{self.state.path}/{x}" for x in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """(thread, created_at, content) of all threads, as of a version."""
        return self._read(list(self.folders(version).values()))

    def put(self, rows: DataFrame, prefix: str = PREFIX, order: tuple[str, ...] = ("created_at", "content")) -> int:
        """Replace or add the rows' threads; the version they are in. Of a thread's rows in this put the greatest by `order` stays."""
        name = F.concat(F.lit(prefix), F.coalesce(F.col("thread").cast("string"), F.lit("default")))
        x = F.struct(F.struct(*order).alias("order"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("content").cast("string").alias("content"))
        new = cut(rows.select(name.alias("thread"), x.alias("x")).groupBy("thread").agg(F.max("x").alias("x")).select("thread", "x.created_at", "x.content"))

        def change(v: int) -> int:
            n = self.buckets(v)
            bucket = (F.crc32(F.col("thread").cast("binary")) % n).cast("int").alias("bucket")
            placed = new.select("*", bucket)
            touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # at most n numbers
            if not touched:
                return v
            held = self.folders(v)
            old = self._read([held[b] for b in touched if b in held]).join(new.select("thread"), "thread", "left_anti").select("*", bucket)
            to = f"data/{uuid.uuid4().hex}-put"
            old.unionByName(placed).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.state.path}/{to}")
            sizes = self.spark.read.parquet(f"{self.state.path}/{to}").groupBy("bucket").count().collect()
            return self.state.write(v, replace={str(r["bucket"]): (f"{to}/bucket={r['bucket']}", r["count"]) for r in sizes}, note={"buckets": str(n)})

        return self.state.retried(change)

    def get(self, *threads: str | None, prefix: str = PREFIX) -> DataFrame:
        """Snapshots of the named threads; none for a thread that is unknown or whose content can't be read."""
        names, v = [f"{prefix}{'default' if t is None else t}" for t in threads], self.state.version()
        n, held = self.buckets(v), self.folders(v)
        wanted = {zlib.crc32(x.encode()) % n for x in names}
        return snapshots(self._read([held[b] for b in sorted(wanted) if b in held]).where(F.col("thread").isin(names)))

    def get_all(self, threads: DataFrame, prefix: str = PREFIX) -> DataFrame:
        """Snapshots of the threads of a table of any size, each once."""
        names = threads.select(F.concat(F.lit(prefix), F.coalesce(F.col("thread").cast("string"), F.lit("default"))).alias("thread"))
        return snapshots(self.read().join(names, "thread", "left_semi"))

    def list(self, before: Column | None = None, limit: int | None = None, prefix: str = PREFIX, having: dict[str, str] | None = None) -> DataFrame:
        """Snapshots, newest first, then by thread: made before a time, at most `limit`, and with these texts in their metadata."""
        rows = self.read().where(F.col("thread").startswith(prefix))
        rows = rows if before is None else rows.where(F.col("created_at") < before)
        rows = reduce(lambda d, kv: d.where(F.try_variant_get(F.try_parse_json("metadata"), f"$['{kv[0]}']", "string") == kv[1]), (having or {}).items(), snapshots(rows))
        rows = rows.orderBy(F.desc_nulls_last("created_at"), "thread")
        return rows if limit is None else rows.limit(limit)

    def sink(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        self.put(rows)
