"""Telemetry spans: validation, statistics and the OTLP form; and scope spans with their operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V


def valid() -> Column:
    """Whether a span keeps the rules on operation, layer, type, status and confidence."""
    one = lambda c, allowed: F.col(c).isNull() | F.col(c).isin(*allowed)
    return F.col("operation").isin(*V.OPERATIONS) & one("layer", V.BOOST) & one("memory_type", V.MEMORY_TYPES) & F.col("status").isin(*V.STATUSES) & (F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0))


def split_valid(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined)."""
    ok = F.coalesce(valid(), F.lit(False))
    return spans.where(ok), spans.where(~ok)


def known_layer(layer: Column) -> Column:
    return F.when(layer.isin(*V.BOOST), layer)


def by_operation(spans: DataFrame, operation: str) -> DataFrame:
    if operation not in V.OPERATIONS:
        raise ValueError(f"{operation!r} is not one of {', '.join(V.OPERATIONS)}")
    return spans.where(F.col("operation") == operation)


def totals(spans: DataFrame) -> DataFrame:
    """One row: total_spans, total_duration_ms, avg_duration_ms, error_count, error_rate."""
    n, errors = F.count("*"), F.count_if(F.col("status") == "error")
    share = lambda x, d: F.coalesce(F.round(x, d), F.lit(0.0))
    return spans.agg(
        n.alias("total_spans"), share(F.sum("duration_ms"), 3).alias("total_duration_ms"), share(F.avg("duration_ms"), 3).alias("avg_duration_ms"), errors.alias("error_count"),
        F.when(n > 0, F.round(errors / n, 4)).otherwise(0.0).alias("error_rate"),
    )


def stats(spans: DataFrame) -> DataFrame:
    """(kind, name, n, duration_ms, errors): all, and by operation and by layer where there is one, in one pass of grouping sets."""
    rolled = spans.groupingSets([[], [F.col("operation")], [F.col("layer")]], "operation", "layer").agg(
        F.grouping("operation").alias("go"), F.grouping("layer").alias("gl"), F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("duration_ms"), F.count_if(F.col("status") == "error").alias("errors")
    )
    kind = F.when((F.col("go") == 1) & (F.col("gl") == 1), "all").when(F.col("go") == 0, "operation").otherwise("layer")
    name = F.when(kind == "all", "").when(kind == "operation", F.col("operation")).otherwise(F.col("layer"))
    return rolled.select(kind.alias("kind"), name.alias("name"), "n", "duration_ms", "errors").where("name is not null")


PREFIX = "gen_ai.memory"
#: The attribute that holds the id of the span in which a span was made.
PARENT = "parent_span_id"
ATTRIBUTES = {"memory_id": "id", "layer": "layer", "memory_type": "type", "confidence": "confidence", "query": "query", "top_k": "top_k", "results_count": "results_count"}


#: One attribute value: the field of its type is set, the others are null and left out of JSON.
SCALARS = {"stringValue": "string", "boolValue": "boolean", "intValue": "string", "doubleValue": "double"}


def any_value(value: Column, kind: T.DataType) -> Column:
    """A value as struct<stringValue, boolValue, intValue, doubleValue, arrayValue>: integers as text, lists by their elements."""

    def scalar(v, k):
        own = "boolValue" if isinstance(k, T.BooleanType) else "intValue" if isinstance(k, T.IntegralType) else "doubleValue" if isinstance(k, T.FractionalType) else "stringValue"
        return [F.when(F.lit(c == own), v.cast(t)).alias(c) for c, t in SCALARS.items()]

    item = f"struct<{','.join(f'{c}:{t}' for c, t in SCALARS.items())}>"
    if isinstance(kind, T.ArrayType):
        held = F.struct(F.transform(value, lambda v: F.struct(*scalar(v, kind.elementType))).alias("values"))
        return F.struct(*[F.lit(None).cast(t).alias(c) for c, t in SCALARS.items()], held.alias("arrayValue"))
    return F.struct(*scalar(value, kind), F.lit(None).cast(f"struct<values:array<{item}>>").alias("arrayValue"))


def otlp(spans: DataFrame, system: str = "lamina") -> DataFrame:
    """Spans in OTLP form: traceId, spanId, parentSpanId, name, kind, times in nanoseconds, typed attributes by key (own ones win), status."""
    start = (F.col("timestamp") * 1_000_000_000).cast("long")
    end = start + (F.col("duration_ms") * 1_000_000).cast("long")
    text = T.StringType()
    fixed = {"gen_ai.system": (F.lit(system), text), f"{PREFIX}.operation": (F.col("operation"), text), f"{PREFIX}.backend": (F.lit("spark"), text)}
    named = fixed | {f"{PREFIX}.{name}": (F.col(c), spans.schema[c].dataType) for c, name in ATTRIBUTES.items()}
    own_type = spans.schema["attributes"].dataType
    own = F.coalesce("attributes", F.create_map().cast(own_type))
    base = F.array(*[F.when(v.isNotNull() & ~F.coalesce(F.map_contains_key(own, F.lit(k)), F.lit(False)), F.struct(F.lit(k).alias("key"), any_value(v, t).alias("value"))) for k, (v, t) in named.items()])
    more = F.transform(F.filter(F.map_entries(own), lambda x: x["key"] != PARENT), lambda x: F.struct(x["key"].alias("key"), any_value(x["value"], own_type.valueType).alias("value")))
    values = F.array_sort(F.concat(F.array_compact(base), more), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return spans.select(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), (F.col("attributes")[PARENT].cast("string") if own_type.keyType == text and isinstance(own_type.valueType, T.StringType) else F.lit(None).cast("string")).alias("parentSpanId"), F.concat(F.lit(f"{PREFIX}."), "operation").alias("name"), F.lit(1).alias("kind"),
        start.cast("string").alias("startTimeUnixNano"), end.cast("string").alias("endTimeUnixNano"), values.alias("attributes"),
        F.struct(F.when(F.col("status") == "ok", 1).otherwise(2).alias("code"), F.coalesce("error_message", F.lit("")).alias("message")).alias("status"), F.col("service_name").alias("serviceName"),
    )


def scope_counts(operations: DataFrame) -> DataFrame:
    """(span, n_operations, first, last, by_operation, by_layer) of scope spans: operations has (span, at, operation, layer)."""
    counts = lambda c: operations.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy("span", c).agg(F.count("*").alias("n")).groupBy("span").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    base = operations.groupBy("span").agg(F.count("*").alias("n_operations"), F.min("at").alias("first"), F.max("at").alias("last"))
    return base.join(counts("operation"), "span", "left").join(counts("layer"), "span", "left")


def scope_stats(operations: DataFrame) -> DataFrame:
    """One row: spans, operations, operations a span."""
    g = operations.groupBy("span").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("d"))
    return g.agg(F.count("*").alias("spans"), F.coalesce(F.sum("n"), F.lit(0)).alias("operations"), F.coalesce(F.round(F.avg("n"), 6), F.lit(0.0)).alias("operations_per_span"), F.coalesce(F.sum("d"), F.lit(0)).alias("duration"))


def latest_span(spans: DataFrame, name: str) -> DataFrame:
    """The latest completed span of a name: spans has (name, end_time, …). Of equally late ones that with the largest columns, from left to right."""
    rest = [F.desc(c) for c, t in spans.dtypes if not t.startswith("map")]
    return spans.where((F.col("name") == name) & F.col("end_time").isNotNull()).orderBy(F.desc("end_time"), *rest).limit(1)
