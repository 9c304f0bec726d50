"""Spans of the engine's calls: nesting, failures, counts, traces."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.operators import telemetry
from lamina.plans.engine import Engine

T0 = datetime(2024, 1, 1)


def test_every_call_leaves_its_span(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    first = e.trace
    id = e.remember("we use the FastAPI framework", "project", as_of=T0)
    e.remember("fix the login task", "session", as_of=T0)
    e.touch(id, T0)
    found = e.search("framework", 3, "project")
    assert [(r["rank"], r["id"]) for r in found] == [(1, id)] and e.search("zebra") == []

    def broken(prompt):
        raise RuntimeError("no model")

    assert e.recall_by_model("framework", broken)["facts"] == ["we use the FastAPI framework"]
    before = e.state.rows("memories")
    e.learn(spark.createDataFrame([("t", "session", "we use the Django framework")], "id string, layer string, content string"), as_of=T0)
    learned = e.state.rows("memories") - before
    e.decay(1)
    e.consolidate(as_of=T0)
    assert e.new_trace() != first
    e.trigger("on_commit", T0)
    e.truncate("provenance")
    with pytest.raises(Exception):
        e.learn(spark.range(1))
    e.stop_tracing()
    e.expire(T0)
    assert e.pending == []
    assert e.start_tracing() == e.trace
    e.clear()
    e.flush()
    spans = [r.asDict() for r in e.state.read("otel_spans").orderBy("timestamp").collect()]
    name = lambda r: (r["operation"], (r["attributes"] or {}).get("method"))
    assert [name(r) for r in spans] == [
        ("store", None), ("store", None), ("update", None), ("search", None), ("search", None), ("retrieve", "recall_by_model"), ("retrieve", None), ("store", "learn"), ("update", "decay"), ("update", "consolidate"),
        ("update", "trigger"), ("delete", "truncate provenance"), ("store", "learn"), ("delete", None),
    ]
    assert len({r["trace_id"] for r in spans}) == 3 and spans[0]["trace_id"] == first
    assert [r["results_count"] for r in spans[3:5]] == [1, 0] and spans[3]["query"] == "framework" and spans[6]["results_count"] == 1
    assert int(spans[7]["attributes"]["rows"]) == learned > 0
    assert [r["status"] for r in spans] == ["ok"] * 12 + ["error", "ok"] and spans[12]["error_message"]
    out = {r.spanId: r for r in telemetry.otlp(e.state.read("otel_spans")).collect()}
    assert {k: r.parentSpanId for k, r in out.items() if r.parentSpanId} == {spans[6]["span_id"]: spans[5]["span_id"]}
    assert all(a.key != telemetry.PARENT for r in out.values() for a in r.attributes)
    assert e.state.read("otel_spans").where(~telemetry.valid() | telemetry.valid().isNull()).count() == 0


def test_threads_do_not_share_parents(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    e = Engine(spark, str(tmp_path))

    def work(i):
        with e._within("update", method=f"outer{i}"):
            with e._within("store", method=f"inner{i}"):
                pass

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(40)))
    ids = {p["span_id"]: p["attributes"]["method"] for p in e.pending}
    inner = [p for p in e.pending if p["attributes"]["method"].startswith("inner")]
    assert len(inner) == 40 and all(ids[p["attributes"][telemetry.PARENT]] == p["attributes"]["method"].replace("inner", "outer") for p in inner)
