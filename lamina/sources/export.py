"""Sinks for spans: JSON lines and OTLP request documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import telemetry


def json_lines(spans: DataFrame, path: str) -> None:
    spans.write.mode("overwrite").json(path)


#: The fields of a span in a JSON document, in order.
FIELDS = ("span_id", "trace_id", "operation", "timestamp", "duration_ms", "memory_id", "layer", "memory_type", "confidence", "query", "top_k", "results_count", "status", "error_message", "attributes", "service_name")
SPAN = "span_id string, trace_id string, operation string, timestamp double, duration_ms double, memory_id string, layer string, memory_type string, confidence double, query string, top_k int, results_count int, status string, error_message string, attributes map<string,string>, service_name string"


def _shares(rows: DataFrame, service: str, by: list[str], batch: int) -> DataFrame:
    """rows with part: a service's rows are dealt into shares of about `batch`."""
    n = rows.groupBy(service).agg(F.ceil(F.count("*") / batch).alias("parts"))
    return rows.join(F.broadcast(n) if n.limit(100_001).count() <= 100_000 else n, service).withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts"))).drop("parts")


def json_documents(spans: DataFrame, exported_at, batch: int = 1000) -> DataFrame:
    """(value): JSON documents {service_name, trace_id, exported_at, span_count, spans}, one for each service and share of about
    `batch` spans; trace_id is that of the share's spans if they have one only. Fields without a value are null."""
    g = _shares(spans.select(*FIELDS), "service_name", ["trace_id", "span_id"], batch).groupBy("service_name", "part")
    g = g.agg(F.array_sort(F.collect_set("trace_id")).alias("traces"), F.count("*").alias("span_count"), F.collect_list(F.struct(*FIELDS)).alias("spans"))
    one = F.when(F.size("traces") == 1, F.get("traces", F.lit(0)))
    return g.select(F.to_json(F.struct("service_name", one.alias("trace_id"), exported_at.cast("string").alias("exported_at"), "span_count", "spans"), {"ignoreNullFields": "false"}).alias("value"))


def from_documents(documents: DataFrame) -> DataFrame:
    """The spans of json_documents(): the way back. Unknown fields are left out, missing ones are null."""
    return documents.select(F.explode(F.from_json("value", f"spans array<struct<{', '.join(x.replace(' ', ':', 1) for x in SPAN.split(', '))}>>")["spans"]).alias("s")).select("s.*")


def otlp_requests(spans: DataFrame, batch: int = 1000, version: str = "1.0.0") -> DataFrame:
    """One JSON document with resourceSpans for every service and share of about `batch` spans; a service is never gathered whole."""
    o = telemetry.otlp(spans)
    rows = _shares(o, "serviceName", ["traceId", "spanId"], batch)
    g = rows.groupBy("serviceName", "part").agg(F.collect_list(F.struct(*[c for c in o.columns if c != "serviceName"])).alias("spans"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("serviceName").alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.struct(F.struct(F.lit("lamina").alias("name"), F.lit(version).alias("version")).alias("scope"), F.col("spans"))
    return g.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))


def otlp_text(spans: DataFrame, path: str, batch: int = 1000) -> None:
    otlp_requests(spans, batch).write.mode("overwrite").text(path)
