"""Rules inside a stream: read again for each micro-batch, their version stamped on every row they made.

Before a micro-batch is worked on, the text of its rules is kept under the batch's number. A batch that is replayed takes
the kept text, whatever the file holds by then, and overwrites its own folder, so its rows and stamps come out
as they did at first. A file that is missing means the defaults; one that can't be parsed, such as one
half written, leaves the rules of the batch before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consolidate as C
from ..operators import lifecycle as L
from ..sources.config import Rules, parse
from ..sources.shared import read_text, write_text_once


def version_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def governed(facts: DataFrame, rules: Rules) -> DataFrame:
    """Facts with expires_at by the time to live of their layer, and pinned: whether a never-forget word keeps them. Null contents are not pinned."""
    ttl = L.expiry(F.col("layer"), F.col("created_at"), rules.ttl_days) if rules.ttl_days else F.lit(None).cast("timestamp_ntz")
    pinned: Column = F.coalesce(X.holds_word(F.col("content"), rules.never), F.lit(False)) if rules.never else F.lit(False)
    return facts.withColumns({"expires_at": ttl, "pinned": pinned})


def triggered(events: DataFrame, rules: Rules) -> DataFrame:
    """(…, pattern, action): each event with every rule it calls for."""
    return C.match_rules(events, events.sparkSession.createDataFrame(list(rules.triggers.items()), "pattern string, action string"))


class Ruled:
    """A sink for foreachBatch: make(rows, rules) with rules_version, one folder for each batch."""

    def __init__(self, spark: SparkSession, rules: str, out: str, make: Callable[[DataFrame, Rules], DataFrame] = governed):
        self.spark, self.rules, self.out, self.make = spark, rules, out.rstrip("/"), make

    def _kept(self, batch: int) -> str | None:
        return read_text(self.spark, f"{self.out}/rules/{batch}.toml")

    def rules_of(self, batch: int) -> tuple[Rules, str]:
        """The rules of a batch and their version; those of the file from its first call on."""
        text = self._kept(batch)
        if text is None:
            text = read_text(self.spark, self.rules) or ""
            try:
                parse(text)
            except (ValueError, TypeError, AttributeError):
                text = self._kept(batch - 1) or ""
            write_text_once(self.spark, f"{self.out}/rules/{batch}.toml", text)
            text = self._kept(batch)
        return parse(text), version_of(text)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rules, version = self.rules_of(batch)
        self.make(rows, rules).withColumn("rules_version", F.lit(version)).write.mode("overwrite").parquet(f"{self.out}/rows/batch={batch}")

    def read(self) -> DataFrame:
        """All rows made so far, with rules_version and batch."""
        return self.spark.read.parquet(f"{self.out}/rows")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
