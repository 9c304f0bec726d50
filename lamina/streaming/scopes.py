"""Scope spans from a stream of open, operation and close events; the spans are those of `operators/scopes.py`.

State is kept by scope: events that are newer than the watermark, and a stack of the open spans. Events are
applied in order once the watermark has passed them, so files and partitions may bring them in any order. An event that
comes after the watermark has passed its time is dropped: a close that late leaves its span open. Such a span, and one that
is never closed, is abandoned by a timer when the watermark is `idle` seconds past the scope's last event. A scope's events go through one task
a micro-batch; its state holds what the watermark holds back, and counts, not operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "scope string, span long, name string, parent long, depth long, start_us long, end_us long, status string, n_operations long, by_operation map<string,bigint>, by_layer map<string,bigint>"
EVENT = ("us", "seq", "kind", "name", "operation", "layer")


def order(event: list) -> tuple:
    """By time and number; of repeated events the least comes first, nulls before all."""
    return (event[0], event[1], *[(x is not None, x or "") for x in event[2:]])


def apply(held: dict, events: list[list], gap: int) -> list[dict]:
    """Bring events, in order, into held (stack, last time and number); the spans that end are returned."""
    out = []
    for us, seq, kind, name, operation, layer in events:
        if held["last"] is not None and us - held["last"] > gap:
            out += abandon(held)
        if held["at"] == [us, seq]:
            continue
        held["at"], held["last"] = [us, seq], us
        stack = held["stack"]
        if kind == "open":
            stack.append({"span": seq, "name": name, "parent": stack[-1]["span"] if stack else None, "start_us": us, "n_operations": 0, "by_operation": {}, "by_layer": {}})
        elif kind == "close" and stack:
            out.append(_ended(held, us, "closed"))
        elif kind == "operation" and stack:
            top = stack[-1]
            top["n_operations"] += 1
            for counts, value in ((top["by_operation"], operation), (top["by_layer"], layer)):
                if value:
                    counts[value] = counts.get(value, 0) + 1
    return out


def _ended(held: dict, us: int, status: str) -> dict:
    depth = len(held["stack"])
    return held["stack"].pop() | {"depth": depth, "end_us": us, "status": status}


def abandon(held: dict) -> list[dict]:
    return [_ended(held, held["last"], "abandoned") for _ in range(len(held["stack"]))]


def _track(idle: float):
    gap = int(idle * 1_000_000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"pending": [], "stack": [], "last": None, "at": None}
        mark = state.getCurrentWatermarkMs() * 1000
        for rows in batches:
            for row in rows[list(EVENT)].itertuples(index=False):
                event = [int(row[0]), int(row[1]), *[None if x is None or x != x else x for x in row[2:]]]
                if event[0] > mark:
                    held["pending"].append(event)
        held["pending"].sort(key=order)
        ready = [e for e in held["pending"] if e[0] <= mark]
        held["pending"] = held["pending"][len(ready) :]
        out = apply(held, ready, gap)
        if held["stack"] and mark - held["last"] > gap:
            out += abandon(held)
        if held["pending"] or held["stack"]:
            state.update((json.dumps(held),))
            due = [held["pending"][0][0]] if held["pending"] else []
            due += [held["last"] + gap] if held["stack"] else []
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([{"scope": key[0], **s} for s in out])[[c.split()[0] for c in OUT.split(", ")]].astype({"parent": "Int64"})

    return run


def completed(events: DataFrame, idle: float = 7200.0, late: str = "1 hour") -> DataFrame:
    """The ended spans of a stream of events (scope string, at, seq, kind, name, operation, layer); events may be later than others by `late`."""
    rows = events.where("scope is not null and at is not null and seq is not null and kind in ('open', 'close', 'operation')")
    rows = rows.withColumn("_t", F.col("at").cast("timestamp")).withWatermark("_t", late).withColumn("us", F.unix_micros("_t"))
    spans = rows.select("scope", "_t", *EVENT).groupBy("scope").applyInPandasWithState(_track(idle), OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: F.timestamp_micros(f"{c}_us").cast("timestamp_ntz").alias(c)
    return spans.select("scope", "span", "name", "parent", "depth", time("start"), time("end"), "status", "n_operations", "by_operation", "by_layer")
