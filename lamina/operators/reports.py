"""Health, distribution and timeline reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from . import lifecycle, provenance


def findings(as_of: Column, threshold: float = 0.5) -> dict[str, Column]:
    return {
        "expired": lifecycle.expired(as_of),
        "low_confidence": F.col("confidence") < threshold,
        "risky_source": ~F.lower("source").isin(*V.TRUSTED),
        "secret_finding": X.has_secrets(F.col("content")),
    }


def health(memories: DataFrame, records: DataFrame, spans: DataFrame, as_of: Column, threshold: float = 0.5, newest: int | None = None) -> DataFrame:
    """One row: counts, coverage by provenance, warnings in order and status. One aggregate over the facts and one over the records.
    All records and spans count, or the newest so many of each if that is given."""
    counts = memories.agg(F.count("*").alias("memory_count"), F.countDistinct("id").alias("n_ids"), *[F.count_if(c).alias(f"{k}_count") for k, c in findings(as_of, threshold).items()])
    recent = lambda df: df if newest is None else df.orderBy(F.desc("timestamp"), "id").limit(newest)
    # One row for each source of a record, or one for a record without: its first row stands for the record.
    last = recent(records).select((provenance.average() < threshold).alias("low"), F.posexplode_outer("sources.memory_id").alias("pos", "id"))
    known = last.join(memories.select("id").distinct().withColumn("known", F.lit(True)).hint("merge"), "id", "left")  # ids of all facts are never broadcast
    first = F.coalesce("pos", F.lit(0)) == 0
    seen = known.agg(F.count_if(first).alias("provenance_records"), F.count_if(first & F.col("low")).alias("low_confidence_retrievals"), F.countDistinct(F.when(F.col("known"), F.col("id"))).alias("covered_memories"))
    late = recent(spans).agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "error").alias("error_spans"))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), [counts, seen, late])
    coverage = F.when(F.col("n_ids") > 0, F.col("covered_memories") / F.col("n_ids")).otherwise(1.0)
    missing = (F.col("memory_count") > 0) & (F.col("provenance_records") == 0)
    warn = [(F.col(f"{k}_count") > 0, name) for k, name in (("expired", "expired"), ("low_confidence", "low_confidence"), ("risky_source", "risky_sources"), ("secret_finding", "secret_findings"))]
    warn += [(missing, "missing_provenance"), (~missing & (coverage < 0.5), "low_provenance_coverage"), (F.col("error_spans") > 0, "otel_errors")]
    warnings = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in warn]))
    return row.withColumns({"coverage": F.round(coverage, 6), "warnings": F.array_join(warnings, ",")}).drop("n_ids").withColumn("status", F.when(F.col("warnings") == "", "ok").otherwise("warn"))


def samples(memories: DataFrame, as_of: Column, threshold: float = 0.5, n: int = 5) -> DataFrame:
    """(category, rank, id, layer, source, preview): the newest n facts of each finding, 120 characters of each."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in findings(as_of, threshold).items()]))
    rows = memories.withColumn("category", F.explode(hits))
    rank = F.row_number().over(W.partitionBy("category").orderBy(F.desc("created_at"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("category", "rank", "id", "layer", "source", F.substring("content", 1, 120).alias("preview"))


def heatmap(memories: DataFrame) -> DataFrame:
    """(layer, n, percent)."""
    g = memories.groupBy("layer").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("layer", "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("percent"))


def top_tags(memories: DataFrame, n: int = 10) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def timeline(memories: DataFrame, log: DataFrame, limit: int = 20) -> DataFrame:
    """(rank, kind, id, at, what): the newest facts and trigger rows together."""
    m = memories.orderBy(F.desc("created_at"), "id").limit(limit).select(F.lit("memory").alias("kind"), "id", F.col("created_at").alias("at"), F.substring("content", 1, 60).alias("what"))
    t = log.orderBy(F.desc("timestamp"), "id").limit(limit).select(F.lit("trigger").alias("kind"), "id", F.col("timestamp").alias("at"), F.col("action").alias("what"))
    top = m.unionByName(t).orderBy(F.desc("at"), "kind", "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("at"), "kind", "id"))).select("rank", "kind", "id", "at", "what")


def audit(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), "id").limit(limit).select("id", "timestamp", "event", "action", F.size("memories_affected").cast("long").alias("n_memories"))


def latest_per(df: DataFrame, key: str, order: str, prefix: str | None = None) -> DataFrame:
    """The last row of every key by order, such as the newest checkpoint of a thread; partial aggregates, no window."""
    rows = df if prefix is None else df.where(F.col(key).startswith(prefix))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != key]), order).alias("x")).select(key, "x.*")


def last_turns(turns: DataFrame, least: int = 20, most: int = 500) -> DataFrame:
    """(conv_id, turn, role, content): the last turn of each conversation, if longer than `least`; at most `most` characters are the fact."""
    last = latest_per(turns, "conv_id", "turn")
    return last.where(F.length("text") > least).select("conv_id", "turn", "role", F.substring("text", 1, most).alias("content"))
