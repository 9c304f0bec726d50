"""Stored answers: a table of what was retrieved, by question, layer, top_k and the version of the facts.

Keys are dealt by hash, so splitting a batch of questions into those answered and those to retrieve is one join on the
key, and what is retrieved is the rest alone. An answer counts while the facts have the version that it was
made from and it is younger than `ttl` seconds; the newest of several counts. Evicting leaves the newest of each key, and of
those the newest `most`; the rows to drop are told by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import days_between

KEY = ("query", "layer", "top_k")


def key(version: Column) -> Column:
    """The hash of what an answer depends on; a null layer, all layers, is a value of its own."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in ((F.col(k).cast("string")) for k in KEY)]
    return F.sha2(F.concat_ws("|", *parts, version.cast("string")), 256)


def newest(answers: DataFrame) -> DataFrame:
    """One answer a key, the latest; of equally late ones that with the smallest text."""
    rest = [c for c in answers.columns if c not in ("key", "answered_at")]
    order = F.struct((-F.unix_micros(F.col("answered_at").cast("timestamp"))).alias("at"), *[F.col(c) for c in rest], F.col("answered_at"))
    return answers.where("key is not null").groupBy("key").agg(F.min(order).alias("x")).select("key", "x.answered_at", *[f"x.{c}" for c in rest])


def fresh(as_of: Column, ttl: float) -> Column:
    """Whether an answer is not older than ttl seconds; one from later than as_of counts as new."""
    return days_between(F.col("answered_at"), as_of) * 86_400 <= ttl


def split(questions: DataFrame, answers: DataFrame, version: Column, as_of: Column, ttl: float = 300.0) -> DataFrame:
    """questions (query_id, query, layer, top_k) with status hit, stale (answered, too long ago) or miss, and the answer of the hits.

    Repeated questions meet one answer each. No cross product: a question has one key and a key one answer.
    """
    asked = questions.withColumn("key", key(version))
    held = newest(answers).select(F.col("key").alias("_key"), "answered_at", "answer")
    met = asked.join(held, F.col("key") == F.col("_key"), "left").drop("_key")
    status = F.when(F.col("answered_at").isNull(), "miss").when(fresh(as_of, ttl), "hit").otherwise("stale")
    return met.withColumn("status", status).withColumn("answer", F.when(F.col("status") == "hit", F.col("answer")))


def evict(answers: DataFrame, as_of: Column, ttl: float = 300.0, most: int = 10_000, version: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted with reason): superseded by a later answer, of an old version of the facts, older than ttl, or beyond the newest `most`."""
    late = newest(answers.select([c for c in answers.columns if not c.startswith("_")]))
    old = F.lit(False) if version is None else F.col("version") != version
    live = late.where(~old & fresh(as_of, ttl))
    kept = live.orderBy(F.desc("answered_at"), "key").limit(most)
    reason = F.when(F.col("_last").isNull(), "superseded").when(old, "version").when(~fresh(as_of, ttl), "age").otherwise("size")
    marks = late.select(F.col("key").alias("_key"), F.col("answered_at").alias("_at"), F.lit(True).alias("_last"))
    same = (F.col("key") == F.col("_key")) & (F.col("answered_at") == F.col("_at"))
    gone = answers.join(kept.select("key", "answered_at"), ["key", "answered_at"], "left_anti").join(marks, same, "left").withColumn("reason", reason)
    return kept, gone.drop("_key", "_at", "_last")
