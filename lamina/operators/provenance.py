"""Where answers came from: records of retrievals and what they show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .store import PROVENANCE, conform


def source_type(confidence: Column) -> Column:
    return F.when(confidence >= 1.0, "explicit").when(confidence >= 0.7, "inferred").otherwise("mentioned")


def record(found: DataFrame, queries: DataFrame, as_of: Column, method: str = "keyword", tree_version: int = 0, searched: int = 0) -> DataFrame:
    """A record for each query: found has (query_id, rank, id, layer, content, confidence)."""
    s = F.struct(
        F.col("rank"), F.col("id").alias("memory_id"), F.col("content"), F.col("layer"), source_type(F.col("confidence")).alias("source_type"), F.col("confidence"),
        F.lit(f"matched via {method} retrieval").alias("match_reason"), F.array(F.lit("root")).alias("trace_path"),
    )
    g = found.groupBy("query_id").agg(F.array_sort(F.collect_list(s)).alias("s"))
    rows = queries.join(g, "query_id", "left").withColumn("s", F.coalesce("s", F.array().cast(g.schema["s"].dataType)))
    sources = F.transform("s", lambda x: x.dropFields("rank"))
    return conform(rows.select(F.col("query_id").alias("id"), "query", sources.alias("sources")).withColumn("avg_confidence", average()), PROVENANCE, timestamp=as_of, method=F.lit(method), tree_version=F.lit(tree_version), total_memories_searched=F.lit(searched))


def average(sources: str = "sources") -> Column:
    """Mean confidence of a record's sources; 0 without any."""
    return F.when(F.size(sources) > 0, F.aggregate(sources, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.size(sources)).otherwise(0.0)


def exploded(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("record_id"), "query", "method", F.explode("sources").alias("s")).select("record_id", "query", "method", "s.*")


def breakdown(records: DataFrame, by: str) -> DataFrame:
    """(record_id, by, n): counts of a record's sources by layer or source_type."""
    return exploded(records).groupBy("record_id", by).agg(F.count("*").alias("n"))


def report(records: DataFrame, query: str | None = None) -> DataFrame:
    """(kind, name, n, avg_confidence): all (records and the mean over all sources), and counts by layer, source_type and method."""
    r = records if query is None else records.where(F.col("query") == query)
    s = exploded(r)
    parts = [
        r.agg(F.count("*").alias("n")).join(s.agg(F.coalesce(F.round(F.avg("confidence"), 6), F.lit(0.0)).alias("avg_confidence"))).select(F.lit("all").alias("kind"), F.lit("").alias("name"), "n", "avg_confidence"),
        *[s.groupBy(F.coalesce(by, F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")).select(F.lit(by).alias("kind"), "name", "n", "avg_confidence") for by in ("layer", "source_type")],
        r.groupBy(F.coalesce("method", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("avg_confidence"), 6).alias("avg_confidence")).select(F.lit("method").alias("kind"), "name", "n", "avg_confidence"),
    ]
    return reduce(DataFrame.unionByName, parts)


def low_confidence(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    return records.withColumn("avg_confidence", average()).where(F.col("avg_confidence") < threshold)


def imbalance(records: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(source_type, n, total, ratio) of the type with more than `ratio` of all sources; no row if none."""
    s = exploded(records).groupBy("source_type").agg(F.count("*").alias("n"))
    t = s.join(F.broadcast(s.agg(F.sum("n").alias("total"))))
    return t.withColumn("ratio", F.col("n") / F.col("total")).where(F.col("ratio") > ratio).select("source_type", "n", "total", F.round("ratio", 6).alias("ratio")).orderBy(F.desc("ratio")).limit(1)


def shown(records: DataFrame) -> DataFrame:
    """Records as JSON, contents cut to 200 characters."""
    cut = F.transform("sources", lambda s: s.withField("content", X.preview(s["content"])))
    return records.withColumn("sources", cut).select("id", F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("json"))
