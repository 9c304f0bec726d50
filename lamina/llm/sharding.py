"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash of
all their columns. Pass two puts each bucket in a canonical order, shuffles it with
Fisher-Yates from a generator seeded by the bucket, and deals it out: the buckets' order
numbers are consecutive, and order number modulo the shard count is the shard, so the
shards' row counts differ by at most one and slots have no gaps (law `rows`). Records move
once; the offsets of buckets come from their row counts.

A bucket is about bucket_bytes and is the most that a task holds. Records that are equal in
every column are counted, numbered and scattered by number, so a third of all rows may be
one record. The result depends only on rows, seed and counts, not on how rows were dealt or
how many tasks there are, so a task that runs again makes the same rows. Null texts have no
bytes; an empty table gives no rows; fewer rows than shards leave shards empty. Columns may have any
name but shard and slot, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, unused

by_value(__name__)

#: Copies of one record that a task makes at a time.
COPIES = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n positions; all draws are made at once."""
    order = list(range(n))
    drawn = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []
    for k, j in zip(range(n - 1, 0, -1), drawn, strict=True):
        order[k], order[j] = order[j], order[k]
    return np.array(order, np.int64)


def _deal(seed: int, names: list[str], own: dict[str, str]):
    def run(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [(own[c], "ascending") for c in ("tie", "next", "copy")]).to_numpy()
        order = order[fisher_yates(len(order), seed, rows.column(own["bucket"])[0].as_py())]
        first = rows.column(own["first"])[0].as_py()
        return rows.take(pa.array(order)).select(names).append_column(own["at"], pa.array(np.arange(first, first + len(order)), pa.int64()))

    return run


def shard(docs: DataFrame, shards: int = 24, seed: int = 23, text: str = "text", bucket_bytes: int = 32 << 20, buckets: int | None = None) -> DataFrame:
    """Every row, with its columns, and shard int and slot long; columns of these names are replaced.

    Unless given, there is a bucket for each bucket_bytes of text, and four for each shard at least.
    """
    docs = docs.drop("shard", "slot")
    names = docs.columns
    own = {c: unused(docs, f"_{c}") for c in ("tie", "next", "copy", "bucket", "first", "at", "part")}
    columns = [F.col(f"`{c}`") for c in names]
    if buckets is None:
        size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 8)).first()[0] or 0
        buckets = max(-(-size // bucket_bytes), 4 * shards)
    rows = docs.withColumns({own["tie"]: F.xxhash64(F.lit(seed), *columns), own["next"]: F.xxhash64(F.lit(seed + 1), *columns)})
    repeated = rows.groupBy(own["tie"], own["next"]).count().where("count > 1").select(own["tie"], own["next"])
    if repeated.take(1):
        many = rows.join(repeated, [own["tie"], own["next"]], "left_semi").groupBy(*columns, own["tie"], own["next"]).agg(F.count("*").alias(own["copy"]))
        # Copies are made from ranges of numbers, which are dealt to tasks first, so no task makes all copies of a record.
        many = many.withColumns({own["part"]: F.explode(F.sequence(F.lit(0).cast("long"), F.col(own["copy"]) - 1, F.lit(COPIES).cast("long")))})
        many = many.repartition(F.xxhash64(own["tie"], own["next"], own["part"]))
        many = many.withColumn(own["copy"], F.explode(F.sequence(F.col(own["part"]), F.least(F.col(own["part"]) + COPIES, F.col(own["copy"])) - 1)))
        rows = rows.join(repeated, [own["tie"], own["next"]], "left_anti").withColumn(own["copy"], F.lit(0).cast("long")).select(*columns, own["tie"], own["next"], own["copy"]).union(many.select(*columns, own["tie"], own["next"], own["copy"]))
    else:
        rows = rows.withColumn(own["copy"], F.lit(0).cast("long"))
    rows = rows.withColumn(own["bucket"], F.pmod(F.xxhash64(own["tie"], own["next"], own["copy"]), F.lit(buckets)))
    # Running sums of the buckets' counts: over parts of 4096 buckets, then within a part.
    counts = rows.groupBy(own["bucket"]).count().withColumn(own["part"], F.floor(F.col(own["bucket"]) / 4096))
    parts = counts.groupBy(own["part"]).agg(F.sum("count").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(W.orderBy(own["part"])) - F.col("n")).drop("n")
    inner = F.sum("count").over(W.partitionBy(own["part"]).orderBy(own["bucket"])) - F.col("count")
    first = counts.withColumn("inner", inner).join(parts, own["part"]).select(own["bucket"], (F.col("before") + F.col("inner")).alias(own["first"]))
    dealt = rows.join(F.broadcast(first) if buckets <= 100_000 else first, own["bucket"])
    schema = T.StructType([*docs.schema.fields, T.StructField(own["at"], T.LongType())])
    out = dealt.groupBy(own["bucket"]).applyInArrow(_deal(seed, names, own), schema)
    return out.select(*columns, (F.col(own["at"]) % shards).cast("int").alias("shard"), F.expr(f"{own['at']} div {shards}").alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 24, **kw) -> None:
    """One folder of Parquet per shard. Each task appends what its buckets deal to a shard; order by slot when reading a shard in order."""
    shard(docs, shards, **kw).write.partitionBy("shard").mode("overwrite").parquet(path)


def digest(docs: DataFrame, shards: int = 24, **kw) -> DataFrame:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shard(docs.select("doc_id", "text"), shards, **kw).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
