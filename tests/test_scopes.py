"""Scope spans: batch and stream against a plain walk over a stack, and the edges."""

import random
from datetime import datetime, timedelta

from lamina.operators import scopes as N
from lamina.operators import telemetry as O
from lamina.streaming import scopes as SN
from pyspark.sql import functions as F

SCHEMA = "scope string, at timestamp_ntz, seq long, kind string, name string, operation string, layer string"
T0 = datetime(2024, 3, 1)


def event(scope, minute, seq, kind, operation=None, layer=None):
    return (scope, T0 + timedelta(minutes=minute), seq, kind, f"n{seq}" if kind == "open" else None, operation, layer)


def walk(rows, idle):
    """The spans, by a literal walk: (scope, span, name, parent, depth, start, end, status, n, by_operation)."""
    out, seen = [], set()
    for scope in sorted({r[0] for r in rows}):
        stack, last = [], None

        def end(at, status, scope=scope, stack=stack):
            s = stack.pop()
            out.append((scope, s["span"], s["name"], s["parent"], len(stack) + 1, s["start"], at, status, sum(s["ops"].values()), tuple(sorted(s["ops"].items()))))

        for _, at, seq, kind, name, operation, _ in sorted(r for r in rows if r[0] == scope):
            if (scope, seq) in seen:
                continue
            seen.add((scope, seq))
            if last and (at - last).total_seconds() > idle:
                while stack:
                    end(last, "abandoned")
            last = at
            if kind == "open":
                stack.append({"span": seq, "name": name, "parent": stack[-1]["span"] if stack else None, "start": at, "ops": {}})
            elif kind == "close" and stack:
                end(at, "closed")
            elif kind == "operation" and stack:
                stack[-1]["ops"][operation] = stack[-1]["ops"].get(operation, 0) + 1
        while stack:
            end(last, "abandoned")
    return sorted(out, key=str)


def taken(df):
    return sorted(((r.scope, r.span, r.name, r.parent, r.depth, r.start, r.end, r.status, r.n_operations, tuple(sorted(r.by_operation.items()))) for r in df.collect()), key=str)


def many(seed, n, scopes=4):
    rng, rows, minute = random.Random(seed), [], 0
    for k in range(n):
        minute += rng.choice([0, 1, 3, 10, 90]) if rng.random() < 0.97 else 400
        scope = "hot" if rng.random() < 0.4 else f"s{rng.randrange(scopes)}"
        kind = rng.choice(["open", "close", "operation", "operation"])
        rows.append(event(scope, minute, k, kind, rng.choice(["store", "search"]) if kind == "operation" else None, "user"))
    return rows + rows[::17]


def test_batch_equals_walk(spark):
    rows = many(3, 900)
    for bucket in (600.0, 86_400.0):
        assert taken(N.completed(spark.createDataFrame(rows, SCHEMA), idle=7200, bucket=bucket)) == walk(rows, 7200)


def test_deep_nesting_and_edges(spark):
    deep = [event("d", k, k, "open") for k in range(200)] + [event("d", 200 + k, 200 + k, "close") for k in range(200)]
    got = {r[1]: r for r in taken(N.completed(spark.createDataFrame(deep, SCHEMA)))}
    assert [got[k][4] for k in range(200)] == list(range(1, 201)) and [got[k][3] for k in range(1, 200)] == list(range(199)) and got[0][3] is None
    assert taken(N.completed(spark.createDataFrame([], SCHEMA))) == []
    # Nulls are left out; an operation or close with nothing open is ignored; a span that is open as of now is active.
    odd = [event(None, 0, 1, "open"), ("e", None, 2, "open", None, None, None), event("e", 0, 3, None), event("e", 1, 4, "close"), event("e", 2, 5, "operation", "store"), event("e", 3, 6, "open"), event("e", 4, 7, "operation", "store", "")]
    df = spark.createDataFrame(odd, SCHEMA)
    (one,) = N.completed(df, as_of=F.lit(T0 + timedelta(minutes=5)).cast("timestamp_ntz")).collect()
    assert (one.span, one.status, one.end, one.n_operations, one.by_layer) == (6, "active", None, 1, {})
    (gone,) = N.completed(df, as_of=F.lit(T0 + timedelta(days=5)).cast("timestamp_ntz")).collect()
    assert (gone.status, gone.end) == ("abandoned", T0 + timedelta(minutes=4))


def test_newest(spark):
    rows = [event("a", 3 * k, 2 * k, "open") for k in range(9)] + [event("a", 3 * k + 1, 2 * k + 1, "close") for k in range(9)]
    done = N.completed(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.span for r in N.newest(done, 3).collect()) == [12, 14, 16]
    same = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 5.0), ("x", 3, 4.0), ("y", 9, 9.0), ("x", 8, None)], "name string, id int, end_time double")
    assert O.latest_span(same, "x").first().id == 2


def stream(spark, tmp, batches, idle, late):
    """Each batch is a file; a file is a micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/in{k}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in*")
    to = SN.completed(source, idle, late).writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/cp").outputMode("append").trigger(availableNow=True).start()
    to.awaitTermination(240)
    assert not to.isActive and to.exception() is None
    return spark.read.parquet(f"{tmp}/out")


def test_stream_equals_batch(spark, tmp_path):
    rows = many(5, 400)
    rng = random.Random(1)
    # Out of order within half an hour and between files.
    mixed = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 25)))
    end = max(r[1] for r in rows)
    parts = [mixed[k : k + 210] for k in range(0, len(mixed), 210)]
    # Later events of another scope bring the watermark past all timers.
    tick = [[("tick", end + timedelta(days=k), 10_000 + k, "operation", None, "x", None)] for k in (2, 4)]
    got = taken(stream(spark, str(tmp_path), parts + tick, 7200, "60 minutes"))
    assert got == walk(rows, 7200) == taken(N.completed(spark.createDataFrame(rows, SCHEMA), idle=7200))


def test_late_close_and_never_closed(spark, tmp_path):
    batches = [
        [event("a", 0, 1, "open"), event("a", 5, 2, "operation", "store"), event("b", 0, 3, "open")],
        [event("tick", 60 * 24, 50, "operation")],
        [event("a", 6, 4, "close"), event("tick", 60 * 48, 51, "operation")],  # long after the watermark passed it
        [event("tick", 60 * 72, 52, "operation")],
    ]
    got = taken(stream(spark, str(tmp_path), batches, 3600, "10 minutes"))
    assert [(r[0], r[1], r[7], r[6]) for r in got] == [("a", 1, "abandoned", T0 + timedelta(minutes=5)), ("b", 3, "abandoned", T0)]
