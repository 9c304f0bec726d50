"""Decay, reinforcement and expiry as pure columns over explicit rules and an explicit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def rule(layer: Column, which: int, rules=None) -> Column:
    """Rate (0) or floor (1) of a layer; a layer without a rule does not decay and has floor 1."""
    rules = V.DECAY if rules is None else rules
    return F.coalesce(*[F.when(layer == k, F.lit(float(v[which]))) for k, v in rules.items()], F.lit((0.0, 1.0)[which]))


def decayed(c: Column, rate: Column, floor: Column, days: Column) -> Column:
    """c * (1 - rate)^days, at least the floor (so a value below it is lifted); explicit facts and non-decaying layers stay."""
    return F.when((c >= 1.0) | (rate <= 0) | (days <= 0), c).otherwise(F.greatest(c * F.pow(1 - rate, days), floor))


def aged(memories: DataFrame, days: Column, rules=None) -> DataFrame:
    """memories as of `days` after their confidence was written: a null layer, one without a rule and explicit facts stay."""
    rate, floor = rule(F.col("layer"), 0, rules), rule(F.col("layer"), 1, rules)
    return memories.withColumn("confidence", F.when(floor >= 1.0, F.col("confidence")).otherwise(decayed(F.col("confidence"), rate, floor, days)))


def days_between(start: Column, end: Column) -> Column:
    """Days with fractions, not below 0."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest((micros(end) - micros(start)) / F.lit(86_400_000_000.0), F.lit(0.0))


def decay(memories: DataFrame, days: float = 1, rules=None) -> tuple[DataFrame, DataFrame]:
    """(new rows, report of what changed: memory_id, layer, old_confidence, new_confidence)."""
    rate, floor = rule(F.col("layer"), 0, rules), rule(F.col("layer"), 1, rules)
    new = F.when(floor >= 1.0, F.col("confidence")).otherwise(decayed(F.col("confidence"), rate, floor, F.lit(float(days))))
    both = memories.withColumn("_new", new)
    report = both.where("_new <> confidence").select(F.col("id").alias("memory_id"), "layer", F.col("confidence").alias("old_confidence"), F.col("_new").alias("new_confidence"))
    return both.withColumn("confidence", F.col("_new")).drop("_new"), report


def flagged(memories: DataFrame, floor: float | None = None, rules=None) -> DataFrame:
    """Facts below their layer's floor, or below `floor` where given."""
    return memories.where(F.col("confidence") < (F.lit(floor) if floor is not None else rule(F.col("layer"), 1, rules)))


def reinforce(memories: DataFrame, ids, as_of: Column, amount: float = 0.1) -> DataFrame:
    mine = F.col("id").isin(*ids) if not isinstance(ids, Column) else ids
    return memories.withColumns({"confidence": F.when(mine, F.least(F.col("confidence") + amount, F.lit(1.0))).otherwise(F.col("confidence")), "created_at": F.when(mine, as_of.cast("timestamp_ntz")).otherwise(F.col("created_at"))})


def expired(as_of: Column) -> Column:
    return F.coalesce(F.col("expires_at") < as_of, F.lit(False))


def expire(memories: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired)."""
    return memories.where(~expired(as_of)), memories.where(expired(as_of))


def should_forget(as_of: Column, never=V.NEVER_FORGET, ttl=None) -> Column:
    """False with a never-forget word, without a time to live of the layer or an expiry; else whether it is past."""
    ttl = V.TTL_DAYS if ttl is None else ttl
    return F.when(X.holds_word(F.col("content"), never) | ~F.col("layer").isin(*ttl), F.lit(False)).otherwise(expired(as_of))


def expiry(layer: Column, as_of: Column, ttl=None) -> Column:
    ttl = V.TTL_DAYS if ttl is None else ttl
    return F.coalesce(*[F.when(layer == k, as_of.cast("timestamp_ntz") + F.make_dt_interval(F.lit(v))) for k, v in ttl.items()], F.lit(None).cast("timestamp_ntz"))
