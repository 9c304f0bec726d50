"""Facts, spans and logs derived from the test tables, so that the operators meet their own vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-15 00:00:00"

FACTS = """
select concat('f', cast(p_partkey as {S})) as id,
 case p_partkey % 3 when 0 then 'project' when 1 then 'session' else 'user' end as layer,
 case p_partkey % 13
  when 0 then concat('we use the ', p_type, ' framework for ', p_brand)
  when 1 then concat('ADR-', cast(p_partkey as {S}), ': ', p_name, ' accepted')
  when 2 then concat('decided to migrate ', p_brand, ' to ', p_type)
  when 3 then concat('prefer ', p_type, ' over ', p_brand)
  when 4 then concat('fix task on ', p_name, ' by dev', cast(p_partkey as {S}), '@example.com')
  when 5 then concat('standup review of ', p_brand, ' password=pw', cast(p_partkey as {S}))
  when 6 then concat('import ', lower(p_type), '_dependency as dep')
  when 7 then concat('contact 555-', cast(100 + p_partkey % 900 as {S}), '-', cast(1000 + p_partkey % 9000 as {S}), ' about ', p_name)
  when 8 then concat('migrated from ', lower(p_type), ' to ', p_name, ' for speed')
  when 9 then concat('maybe evaluating ', p_name, ' bearer tok', cast(p_partkey as {S}))
  when 10 then concat('built with ', lower(p_type), '_runtime for ', p_name)
  when 11 then concat('rotate AKIA', lpad(cast(p_partkey as {S}), 16, '0'), ' ssn 123-45-', lpad(cast(p_partkey % 10000 as {S}), 4, '0'))
  else concat('misc note ', p_name) end as content,
 case p_partkey % 5 when 0 then 'manual' when 1 then 'MCP' when 2 then 'external' when 3 then 'reflection' else 'legacy' end as source,
 case p_partkey % 4 when 0 then 1.0e0 when 1 then 0.7e0 when 2 then 0.5e0 else 0.2e0 end as confidence,
 {TS} as created_at,
 case p_partkey % 3 when 0 then null when 1 then {TS} + interval '7' day else {TS} + interval '90' day end as expires_at
from {part}
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = FACTS.format(S="string", TS="(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(p_partkey as int) * 17, 0))", part="{part}")
    return spark.sql(text, part=read(spark, sf_dir, "part")).withColumn("tags", F.array("layer", "source"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    op = {"signup": "store", "view": "retrieve", "click": "search", "purchase": "update", "error": "delete"}
    operation = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in op.items()])
    layer = F.coalesce(*[F.when(F.col("event_id") % 4 == i, F.lit(v)) for i, v in enumerate(("project", "session", "user"))])
    null = lambda t: F.lit(None).cast(t)
    return e.select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), operation.alias("operation"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"), F.col("value").alias("duration_ms"), null("string").alias("memory_id"), layer.alias("layer"), null("string").alias("memory_type"),
        null("double").alias("confidence"), null("string").alias("query"), null("int").alias("top_k"), null("int").alias("results_count"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        null("string").alias("error_message"), null("map<string,string>").alias("attributes"), F.lit("svc").alias("service_name"),
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    commit = F.col("event_type") == "signup"
    return e.select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"), F.when(commit, "on_commit").otherwise("on_session_end").alias("event"),
        F.when(commit, "consolidate session -> project").otherwise("summarize session -> user").alias("action"),
        F.transform(F.sequence(F.lit(1), (F.col("event_id") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("f"), (F.col("event_id") + i).cast("string"))).alias("memories_affected"), F.col("ts").alias("timestamp"),
    )


#: A deep adjacency out of part: chains of some hundred nodes below each thousandth, with orphans and cycles.
ADJACENCY = """
select p_partkey as node, case when p_partkey % 1000 = 0 then null
 when p_partkey % 211 = 1 then -p_partkey
 when p_partkey % 309 = 5 then p_partkey + 3
 else p_partkey - least(p_partkey % 1000, 1 + p_partkey % 3) end as parent, p_name as name
from {part}
"""


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ADJACENCY, part=read(spark, sf_dir, "part"))


def scope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, operation and close events of scopes, out of events: a user's signups open, purchases close, the rest are operations."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").otherwise("operation")
    operation = F.when(F.col("event_type") == "view", "retrieve").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "error", "delete")
    layer = F.when(F.col("event_id") % 4 == 0, "project").when(F.col("event_id") % 4 == 1, "session").when(F.col("event_id") % 4 == 2, "user")
    return e.select(
        F.col("user_id").cast("string").alias("scope"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.when(kind == "open", F.concat(F.lit("task "), (F.col("event_id") % 7).cast("string"))).alias("name"), operation.alias("operation"), F.when(kind == "operation", layer).alias("layer"),
    )
