"""Consolidation, trigger rules and reflection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from .store import MEMORY, TRIGGER, conform


def move(memories: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, ids that moved)."""
    return memories.withColumn("layer", F.when(F.col("layer") == source, F.lit(target)).otherwise(F.col("layer"))), memories.where(F.col("layer") == source).select("id")


def log_row(moved: DataFrame, event: str, action: str, as_of: Column, extra: str | None = None) -> DataFrame:
    """A trigger-log row with the moved ids; none if nothing moved."""
    ids = moved.agg(F.array_sort(F.collect_list("id")).alias("memories_affected")).where(F.size("memories_affected") > 0)
    if extra is not None:
        ids = ids.withColumn("memories_affected", F.array_append("memories_affected", F.lit(extra)))
    return conform(ids.withColumns({"event": F.lit(event), "action": F.lit(action)}), TRIGGER, id=F.uuid(), timestamp=as_of)


def move_logged(memories: DataFrame, log: DataFrame, source: str, target: str, event: str, action: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(memories, log) of one commit."""
    new, moved = move(memories, source, target)
    return new, log.unionByName(log_row(moved, event, action, as_of))


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event, pattern, action) of every rule whose pattern contains the event, in either case: a theta join with the few rules."""
    return events.join(F.broadcast(rules), F.lower("pattern").contains(F.lower("event")))


def fire(event: str, memories: DataFrame, log: DataFrame, as_of: Column, triggers: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(memories, log, actions run): every matching rule in order; consolidate and summarize move, others do nothing."""
    ran = []
    for pattern, action in (V.TRIGGERS if triggers is None else triggers).items():
        if event.lower() in pattern.lower():
            said = X.parse_action(action)
            if said["verb"] in ("consolidate", "summarize"):
                memories, log = move_logged(memories, log, said["from"], said["to"], event, action, as_of)
            ran.append(action)
    return memories, log, ran


def last_activity(memories: DataFrame, log: DataFrame) -> DataFrame:
    """One row: the newest time of either table."""
    return memories.select(F.col("created_at").alias("t")).union(log.select("timestamp")).agg(F.max("t").alias("last_activity"))


def inactive(memories: DataFrame, log: DataFrame, as_of: Column, hours: float = 2) -> DataFrame:
    """One row: whether the last activity is more than `hours` before as_of; false without any."""
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    return last_activity(memories, log).select(F.coalesce(F.col("last_activity") < as_of - gap, F.lit(False)).alias("inactive"))


def summary(memories: DataFrame, by: str = "layer") -> DataFrame:
    """(by, n, summary): distinct non-empty contents, first seen first, joined by '; '. Repeats are aggregated away before a text is gathered."""
    once = memories.where("content is not null and content <> ''").groupBy(by, "content").agg(F.min(F.struct("created_at", "id")).alias("o"))
    parts = once.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("o", "content"))).alias("x"))
    return parts.select(by, F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda v: v["content"]), "; ").alias("summary"))


def reflect(memories: DataFrame, log: DataFrame, event: str, as_of: Column, reflection_id: str, to_layer: str = "project", summarise: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories, log): the session's facts move to to_layer, with a fact that sums them up and a log row of all; nothing if there are none.

    summarise is a Python callable, such as a model's, on the joined contents of the session (one text on the driver).
    """
    said = summary(memories.where("layer = 'session'"))
    if summarise is not None:
        first = said.first()
        said = memories.sparkSession.createDataFrame([(first.layer, first.n, summarise(first.summary))] if first else [], "layer string, n long, summary string")
    text = F.concat(F.lit(f"Session reflection ({event}): "), X.redact(F.col("summary")))
    fact = said.select(
        F.lit(reflection_id).alias("id"), F.lit(to_layer).alias("layer"), text.alias("content"), F.lit("reflection").alias("source"), F.lit(0.9).alias("confidence"), as_of.alias("created_at"),
        F.array(F.lit("reflection"), F.lit(event), F.lit("auto-consolidated")).alias("tags"),
    )
    new, moved = move(memories, "session", to_layer)
    return new.unionByName(conform(fact, MEMORY)), log.unionByName(log_row(moved, event, f"consolidate session -> {to_layer}", as_of, reflection_id))


def due(force: bool, committed: Callable[[], bool] | None, memories: DataFrame, log: DataFrame, as_of: Column, hours: float = 2) -> str | None:
    """The event that calls for reflection, in order: manual, git_commit, inactivity; None if there is none."""
    if force:
        return "manual"
    if committed is not None and committed():
        return "git_commit"
    return "inactivity" if inactive(memories, log, as_of, hours).first().inactive else None
