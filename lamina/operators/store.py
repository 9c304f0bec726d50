"""Scans, pages and changes of the store's tables. A change is a function from the old rows to the new ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp_ntz": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType()),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def schema(text: str, **kinds: T.DataType) -> T.StructType:
    """A schema from 'name kind, …' without a session."""
    return T.StructType([T.StructField(n, (KINDS | kinds)[k]) for n, k in (x.split() for x in text.split(","))])


SOURCE = schema("memory_id string, content string, layer string, source_type string, confidence double, match_reason string, trace_path strings")
MEMORY = schema("id string, layer string, content string, source string, confidence double, created_at timestamp_ntz, expires_at timestamp_ntz, tags strings")
TRIGGER = schema("id string, event string, action string, memories_affected strings, timestamp timestamp_ntz")
PROVENANCE = schema("id string, query string, timestamp timestamp_ntz, method string, tree_version int, total_memories_searched long, avg_confidence double, sources sources", sources=T.ArrayType(SOURCE))
SPAN = schema("id string, trace_id string, span_id string, operation string, timestamp double, duration_ms double, memory_id string, layer string, memory_type string, confidence double, query string, top_k int, results_count int, status string, error_message string, attributes map, service_name string")
NODE = schema("node_id string, parent_id string, depth int, layer string, title string, summary string, n_memories long, confidence double")
ANSWER = schema("key string, version long, answered_at timestamp_ntz, answer string")
TABLES = {"memories": MEMORY, "triggers_log": TRIGGER, "provenance": PROVENANCE, "otel_spans": SPAN, "tree_nodes": NODE, "answers": ANSWER}


def conform(df: DataFrame, schema: T.StructType, **defaults: Column) -> DataFrame:
    """The columns of schema from df; one that df lacks is its default or null."""
    return df.select([(F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])


def rows(new: DataFrame, as_of: Column) -> DataFrame:
    """Rows to insert, redacted. Rows without id, source, confidence or time get a uuid, manual, 1 and as_of."""
    made = conform(new, MEMORY, id=F.uuid(), source=F.lit("manual"), confidence=F.lit(1.0), created_at=as_of, tags=F.array().cast("array<string>"))
    return made.withColumn("content", X.redact(F.col("content")))


def insert(memories: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Rows of new, as rows() makes them, beside the old ones."""
    return memories.unionByName(rows(new, as_of))


def get(memories: DataFrame, id: str) -> DataFrame:
    return memories.where(F.col("id") == id)


def newest(memories: DataFrame, layer: str | None = None, limit: int | None = None) -> DataFrame:
    rows = memories if layer is None else memories.where(F.col("layer") == layer)
    rows = rows.orderBy(F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit)


def delete(memories: DataFrame, id: str) -> DataFrame:
    return memories.where(~F.col("id").eqNullSafe(F.lit(id)))


def delete_layer(memories: DataFrame, layer: str | None = None) -> DataFrame:
    return memories.where(F.lit(False)) if layer is None else memories.where(~F.col("layer").eqNullSafe(F.lit(layer)))


def update(memories: DataFrame, id: str, column: str, value: Column) -> DataFrame:
    """Set layer, confidence or created_at of one row."""
    return memories.withColumn(column, F.when(F.col("id") == id, value.cast(memories.schema[column].dataType)).otherwise(F.col(column)))


def below_confidence(memories: DataFrame, threshold: float, layer: str | None = None) -> DataFrame:
    low = memories.where(F.col("confidence") < threshold)
    return low if layer is None else low.where(F.col("layer") == layer)


def page(df: DataFrame, limit: int, offset: int = 0, time: str = "timestamp", key: str = "id", **equal) -> DataFrame:
    """A page of rows, newest first, of those that equal the given values."""
    rows = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in equal.items() if v is not None], df)
    return rows.orderBy(F.desc(time), key).offset(offset).limit(limit)


def prune(df: DataFrame, keep: int = 10_000, time: str = "timestamp", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): the newest `keep` rows, and the others by an anti join."""
    kept = df.orderBy(F.desc(time), key).limit(keep)
    return kept, df.join(kept.select(key), key, "left_anti")


def stats(**tables: DataFrame) -> DataFrame:
    """(table, rows) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()])


def empty(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))
