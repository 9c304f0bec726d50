"""Scope spans out of open, operation and close events: nested, with the operations made in each.

Events are (scope, at timestamp_ntz, seq long, kind, name, operation, layer), kind `open`, `close` or `operation`, in
the order of (at, seq) within a scope. An open event begins a span inside the innermost open one of its scope, a close event ends the innermost,
an operation belongs to the innermost. A close or an operation with nothing open is ignored. A scope without events for more than `idle`
seconds has been left: what is open then is abandoned, and ends with the scope's last event. Events equal in scope, at and seq are one; of
different ones the least counts. Events without scope, at, seq or kind are left out. No events give no spans.

Depths come from running sums. They go over time buckets of a scope, then over the rows of a bucket, and spans are
told apart within one root span, so a scope with a third of all events is spread over many tasks. `streaming/scopes.py` makes the same spans from a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut
from .telemetry import scope_counts

BEFORE = (W.unboundedPreceding, -1)
UPTO = (W.unboundedPreceding, W.currentRow)


def distinct(events: DataFrame) -> DataFrame:
    """One event for each (scope, at, seq)."""
    rows = events.where("scope is not null and at is not null and seq is not null and kind in ('open', 'close', 'operation')")
    least = rows.groupBy("scope", "at", "seq").agg(F.min(F.struct("kind", "name", "operation", "layer")).alias("x"))
    return least.select("scope", "at", "seq", "x.*")


def _us(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def runs(events: DataFrame, idle: float, bucket: float) -> DataFrame:
    """events with run, the time in microseconds at which the scope's stretch without a gap above idle began, and _b, a time bucket."""
    gap = int(idle * 1_000_000)
    inner, across = W.partitionBy("scope", "_b").orderBy("at", "seq"), W.partitionBy("scope").orderBy("_b")
    rows = events.withColumn("_us", _us("at")).withColumn("_b", F.floor(F.col("_us") / int(bucket * 1_000_000)))
    rows = rows.withColumn("_new", F.when(F.col("_us") - F.lag("_us").over(inner) > gap, F.col("_us")))
    rows = rows.withColumn("_start", F.max("_new").over(inner.rowsBetween(*UPTO)))
    b = rows.groupBy("scope", "_b").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_new").alias("_inner"))
    left = F.lag("_last").over(across)
    b = b.withColumn("_own", F.when(left.isNull() | (F.col("_first") - left > gap), F.col("_first")))
    b = b.withColumn("_base", F.coalesce("_own", F.max(F.coalesce("_inner", "_own")).over(across.rowsBetween(*BEFORE)))).select("scope", "_b", "_base")
    return rows.join(b, ["scope", "_b"]).withColumn("run", F.coalesce("_start", "_base")).drop("_new", "_start", "_base")


def depths(rows: DataFrame) -> DataFrame:
    """rows of runs with depth, the number of open spans after the event; closes with nothing open don't count."""
    keys = ["scope", "run"]
    inner, across = W.partitionBy(*keys, "_b").orderBy("at", "seq").rowsBetween(*UPTO), W.partitionBy(*keys).orderBy("_b")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = rows.withColumn("_s", F.sum(step).over(inner)).withColumn("_m", F.min("_s").over(inner))
    b = rows.groupBy(*keys, "_b").agg(F.sum(step).alias("_t"), F.min("_s").alias("_low"))
    b = b.withColumn("_c", F.coalesce(F.sum("_t").over(across.rowsBetween(*BEFORE)), F.lit(0)))
    b = b.withColumn("_floor", F.min(F.col("_c") + F.col("_low")).over(across.rowsBetween(*BEFORE))).select(*keys, "_b", "_c", "_floor")
    # How far the sum would have sunk below zero is what was closed with nothing open.
    depth = F.col("_c") + F.col("_s") - F.least(F.lit(0), "_floor", F.col("_c") + F.col("_m"))
    return rows.join(b, [*keys, "_b"]).withColumn("depth", depth).drop("_s", "_m", "_c", "_floor")


def roots(rows: DataFrame) -> DataFrame:
    """rows of depths with root, the number within its run of the outermost span that an event is in or follows."""
    keys = ["scope", "run"]
    inner, across = W.partitionBy(*keys, "_b").orderBy("at", "seq").rowsBetween(*UPTO), W.partitionBy(*keys).orderBy("_b")
    outer = ((F.col("kind") == "open") & (F.col("depth") == 1)).cast("long")
    b = rows.groupBy(*keys, "_b").agg(F.sum(outer).alias("_t")).select(*keys, "_b", F.coalesce(F.sum("_t").over(across.rowsBetween(*BEFORE)), F.lit(0)).alias("_c"))
    return rows.withColumn("_n", F.sum(outer).over(inner)).join(b, [*keys, "_b"]).withColumn("root", F.col("_n") + F.col("_c")).drop("_n", "_c")


def completed(events: DataFrame, idle: float = 7200.0, as_of: Column | None = None, bucket: float = 3600.0) -> DataFrame:
    """(scope, span, name, parent, depth, start, end, status, n_operations, by_operation, by_layer) of every span.

    span and parent are the seq of opening events; status is `closed`, `abandoned`, or, where as_of is given and the scope's last event
    isn't longer ago than idle, `active`, without an end.
    """
    rows = cut(roots(cut(depths(cut(runs(distinct(events), idle, bucket))))))
    last = rows.groupBy("scope", "run").agg(F.max("at").alias("_last"))
    level = F.col("depth") + (F.col("kind") == "close").cast("int")
    own = rows.where("root > 0").withColumn("level", level).withColumn("child", F.lit(None).cast("long"))
    # An open event is seen by the level above too, which tells its parent.
    seen = own.union(own.where("kind = 'open' and depth > 1").withColumns({"level": F.col("level") - 1, "child": F.col("seq"), "kind": F.lit("child")})).where("level > 0")
    w = W.partitionBy("scope", "run", "root", "level").orderBy("at", "seq").rowsBetween(*UPTO)
    seen = cut(seen.withColumn("span", F.last(F.when(F.col("kind") == "open", F.struct("seq", "at")), ignorenulls=True).over(w)).where("span is not null"))
    key = ["scope", "run", "span"]
    opened = F.when(F.col("kind") == "open", F.struct("name", "level"))
    spans = seen.where("kind in ('open', 'close')").groupBy(*key).agg(F.first(opened, ignorenulls=True).alias("o"), F.min(F.when(F.col("kind") == "close", F.col("at"))).alias("closed"))
    parents = seen.where("kind = 'child'").select("scope", "run", F.struct(F.col("child").alias("seq"), "at").alias("span"), F.col("span.seq").alias("parent"))
    made = seen.where("kind = 'operation'").select(F.struct(*key).alias("span"), "at", "operation", "layer")
    counts = scope_counts(made).select("span.scope", "span.run", "span.span", "n_operations", "by_operation", "by_layer")
    full = spans.join(last, ["scope", "run"]).join(parents, key, "left").join(counts, key, "left")
    left = F.lit(True) if as_of is None else F.unix_micros(as_of.cast("timestamp")) - _us("_last") > int(idle * 1_000_000)
    status = F.when(F.col("closed").isNotNull(), "closed").when(left, "abandoned").otherwise("active")
    end = F.when(status == "closed", F.col("closed")).when(status == "abandoned", F.col("_last"))
    return full.select(
        "scope", F.col("span.seq").alias("span"), "o.name", "parent", F.col("o.level").alias("depth"), F.col("span.at").alias("start"), end.alias("end"), status.alias("status"),
        F.coalesce("n_operations", F.lit(0)).cast("long").alias("n_operations"), *[F.coalesce(c, F.create_map().cast("map<string,bigint>")).alias(c) for c in ("by_operation", "by_layer")],
    )


def newest(spans: DataFrame, most: int = 50) -> DataFrame:
    """The newest `most` ended spans of each scope, as a tracker keeps them; of equally late ones the later opened."""
    order = W.partitionBy("scope").orderBy(F.desc("end"), F.desc("start"), F.desc("span"))
    return spans.where("end is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
