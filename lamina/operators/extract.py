"""Extraction of facts from text: one row for every accepted line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def lines(df: DataFrame, key: str = "id", text: str = "content", layer: str = "layer") -> DataFrame:
    """(key, layer, line_no, line) of the stripped lines of ten or more characters, dealt evenly to tasks: short facts lie in few files, and the patterns take far longer than their reading."""
    cut = df.select(F.col(key).alias("key"), F.col(layer).alias("layer"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return cut.withColumn("line", X.strip(F.col("line"))).where(F.length("line") >= 10).repartition(tasks)


def candidates(line, never=V.NEVER_FORGET):
    """array<struct<content, level, tag>>: the acceptable content of each pattern, in their order. Contents are elements of an array, so each is extracted once, not once for each test."""
    found = []
    for pattern, group, level, tag in V.EXTRACTION:
        content = X.strip(F.nullif(F.regexp_extract(line, f"(?i){pattern}", group), F.lit("")), ". ;,\t")
        found.append(F.struct(content.alias("content"), F.lit(level).alias("level"), F.lit(tag).alias("tag")))
    return F.filter(F.array(*found), lambda x: (F.length(x["content"]) >= 10) & ~X.holds_word(x["content"], never) & (F.size(X.pii_labels(x["content"])) == 0))


def by_pattern(df: DataFrame, key: str = "id", text: str = "content", layer: str = "layer", never=V.NEVER_FORGET, confidence=None) -> DataFrame:
    """(key, line_no, layer, content, source, confidence, tags) of the first pattern whose content is acceptable: a refused one passes to the next. Of equal first 50 characters in one text the first line stays."""
    levels = V.CONFIDENCE | (confidence or {})
    rows = lines(df, key, text, layer).select("key", "layer", "line_no", F.explode(F.slice(candidates(F.substring("line", 1, 500), never), 1, 1)).alias("hit"))
    first = F.row_number().over(W.partitionBy("key", F.lower(F.substring("hit.content", 1, 50))).orderBy("line_no"))
    level = F.coalesce(*[F.when(F.col("hit.level") == k, F.lit(float(v))) for k, v in levels.items()], F.lit(0.5))
    kept = rows.withColumn("nth", first).where("nth = 1")
    return kept.select("key", "line_no", "layer", "hit.content", F.lit("heuristic_extract").alias("source"), level.alias("confidence"), F.array("layer", "hit.tag", "hit.level").alias("tags"))


def by_marker(df: DataFrame, key: str = "id", text: str = "content", layer: str = "layer", confidence=None) -> DataFrame:
    """(key, line_no, layer, content, source, confidence, tags) of the lines whose markers give 0.5 or more."""
    rows = lines(df, key, text, layer).withColumn("confidence", X.line_confidence(F.col("line"), confidence)).where("confidence >= 0.5")
    return rows.select("key", "line_no", "layer", F.col("line").alias("content"), F.lit("heuristic").alias("source"), "confidence", F.array("layer", F.lit("auto-extracted")).alias("tags"))


def from_replies(df: DataFrame, reply: str = "reply", layer: str = "layer", never=V.NEVER_FORGET, confidence=None, key: str | None = None) -> DataFrame:
    """Facts from JSON replies of a language model: {memories: [{content, confidence, tags}]}, also inside a json fence.
    Short, secret or personal contents are left out; the confidence becomes the nearest level. With key, that column comes first."""
    body = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col(reply))
    parsed = F.from_json(body, "memories array<struct<content:string,confidence:double,tags:array<string>>>")
    kept = [key] if key else []
    rows = df.select(*kept, layer, F.explode(parsed["memories"]).alias("m"))
    content = X.strip(F.col("m.content"))
    good = (F.length(content) >= 5) & ~X.holds_word(content, never) & (F.size(X.pii_labels(content)) == 0)
    return rows.where(good).select(*kept, layer, content.alias("content"), F.lit("llm_extract").alias("source"), X.nearest_level(F.coalesce("m.confidence", F.lit(0.5)), confidence).alias("confidence"), F.coalesce("m.tags", F.array(F.col(layer))).alias("tags"))
