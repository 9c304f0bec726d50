"""Versions made of parts and delete vectors: what is written, what is read, and writers at the same time."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lamina.operators import lifecycle, store
from lamina.plans.engine import Engine
from lamina.sources.state import Conflict, State

T0 = datetime(2024, 1, 1)


def facts(spark, n, start=0, layer="session", confidence=0.8):
    rows = spark.range(start, start + n).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), F.lit(layer).alias("layer"), F.concat(F.lit("fact number "), F.col("id").cast("string")).alias("content"), F.lit(confidence).alias("confidence"))
    return store.rows(rows, F.lit("2024-01-01").cast("timestamp_ntz"))


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def written(path, before):
    new = {f: n for f, n in files(path).items() if f not in before}
    assert all(files(path)[f] == n for f, n in before.items())  # nothing that was there is written again
    return len(new), sum(new.values())


def test_writes_do_not_grow_with_the_table(spark, tmp_path):
    costs = []
    for n in (10, 20_000):
        e = Engine(spark, str(tmp_path / str(n)))
        e.state.append(memories=facts(spark, n))
        steps = {
            "remember": lambda e=e: e.remember("we use the FastAPI framework", "project"), "recall": lambda e=e: e.recall("FastAPI"), "flush": lambda e=e: e.flush(), "forget": lambda e=e: e.forget("m3"),
            "set_layer": lambda e=e: e.set_layer("m4", "user"), "decay": lambda e=e: e.decay(2),
        }
        cost = {}
        for name, step in steps.items():
            before = files(e.state.path)
            step()
            cost[name] = written(e.state.path, before)
        costs.append(cost)
    small, large = costs
    assert {k: v[0] for k, v in small.items()} == {k: v[0] for k, v in large.items()}
    assert small["remember"][0] == small["recall"][0] == small["flush"][0] == small["forget"][0] == 1 and small["decay"] == (0, 0)
    for name in small:
        assert large[name][1] <= small[name][1] + 600, (name, small[name], large[name])


def test_appends_at_the_same_time_all_land(spark, tmp_path):
    s = State(spark, str(tmp_path / "m"), attempts=60)
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: State(spark, s.path, attempts=60).append(memories=facts(spark, 5, 10 * i)), range(6)))
    assert sorted(versions) == list(range(1, 7)) and s.read("memories").select("id").distinct().count() == 30 == s.rows("memories")
    assert [s.read("memories", v).count() for v in range(7)] == [0, 5, 10, 15, 20, 25, 30]  # old versions still read


def test_deletes_updates_and_versions(spark, tmp_path):
    s = State(spark, str(tmp_path / "m"))
    twice = facts(spark, 4).unionByName(facts(spark, 4)).withColumn("id", F.when(F.col("id") != "m0", F.col("id")))
    s.append(memories=twice)
    assert s.delete("memories", F.col("id") == "m1") == 2 and s.delete("memories", F.col("id") == "no") == 0
    assert s.update("memories", F.col("content") == "fact number 2", layer=F.lit("user")) and not s.update("memories", F.col("id") == "no", layer=F.lit("user"))
    assert sorted((r.id or "", r.layer) for r in s.read("memories").collect()) == [("", "session")] * 2 + [("m2", "user")] * 2 + [("m3", "session")] * 2
    assert s.delete("memories", F.col("id").isNull()) == 2 and s.rows("memories") == s.read("memories").count() == 4
    assert s.read("memories", 1).count() == 8 and s.read("memories", 2).count() == 6


def test_writers_conflict_and_are_retried(spark, tmp_path):
    s = State(spark, str(tmp_path / "m"))
    s.append(memories=facts(spark, 5))
    spot = lambda i: s.positions("memories", 1).where(F.col("id") == i).select(F.col("_file").alias("file"), F.col("_row").alias("row"))
    s.write(1, delete={"memories": spot("m1")})
    assert s.write(1, delete={"memories": spot("m2")}) == 3  # another row: put on top
    with pytest.raises(Conflict):
        s.write(1, delete={"memories": spot("m1")})
    with pytest.raises(Conflict):
        s.write(1, replace={"memories": facts(spark, 1)})
    s.append(triggers_log=spark.createDataFrame([], store.TRIGGER))
    assert s.write(3, replace={"memories": facts(spark, 2)}) == 5  # another table was changed: no conflict
    calls = []

    def change(v):
        calls.append(v)
        if len(calls) == 1:
            raise Conflict("once")
        return v

    assert s.retried(change) == 5 and len(calls) == 2


def test_compaction_keeps_rows_and_later_appends(spark, tmp_path):
    s = State(spark, str(tmp_path / "m"), aged={"memories": lifecycle.aged})
    for i in range(4):
        s.append(memories=facts(spark, 3, 3 * i))
    s.delete("memories", F.col("id").isin("m1", "m7"))
    s.write(age={"memories": 3.0})
    want = sorted(map(tuple, s.read("memories").drop("tags").collect()))
    changed = s.changed("memories")
    assert s.compact("memories", parts=4) == ["memories"] and s.compact("memories", parts=4) == []
    held = s.table("memories")
    assert (len(held["parts"]), held["deletes"], held["rows"], s.changed("memories")) == (1, [], 10, changed)
    assert sorted(map(tuple, s.read("memories").drop("tags").collect())) == want
    # rows appended while a compaction reads stay beside it
    v = s.version()
    s.append(memories=facts(spark, 2, 100))
    s.write(v, replace={"memories": s.read("memories", v)}, same=("memories",))
    assert s.read("memories").count() == 12 == s.rows("memories")


def test_decay_is_kept_in_the_state(spark, tmp_path):
    """Due or not is known to any engine on the state, and facts fade by what was recorded after they were written."""
    path = str(tmp_path / "m")
    a = Engine(spark, path)
    a.state.append(memories=facts(spark, 1))
    assert [a.decay_if_due(24, T0), Engine(spark, path).decay_if_due(24, T0 + timedelta(hours=23))] == [False, False]
    before = files(path)
    assert Engine(spark, path).decay_if_due(24, T0 + timedelta(hours=60)) and files(path).keys() == before.keys()
    b = Engine(spark, path)
    assert not b.decay_if_due(24, T0 + timedelta(hours=61))
    b.state.append(memories=facts(spark, 1, 1))
    assert b.decay_if_due(24, T0 + timedelta(hours=84))
    got = {r.id: r.confidence for r in Engine(spark, path).memories().collect()}
    assert got == {"m0": pytest.approx(0.8 * 0.95**3.5), "m1": pytest.approx(0.8 * 0.95)}
    b.set_confidence("m0", 0.5)
    b.decay(1)
    assert b.memories().where("id = 'm0'").first().confidence == pytest.approx(0.475)
    b.decay(1000)
    assert {r.confidence for r in b.memories().collect()} == {0.3}  # the floor


def test_stored_answers(spark, tmp_path):
    """Answers are found by any engine on the state until the facts change or they are too old; others are evicted."""
    path = str(tmp_path / "m")
    e = Engine(spark, path)
    e.state.append(memories=facts(spark, 30, layer="project"))
    asked = spark.createDataFrame([("a", "fact number 7"), ("b", "fact number 7"), ("c", "zebra"), ("d", None)], "query_id string, query string")
    said = lambda engine, at: {r.query_id: (r.status, tuple(r.facts)) for r in engine.recall_stored(asked, 3, as_of=at, ttl=60).collect()}
    first = said(e, T0)
    assert {v[0] for v in first.values()} == {"miss"} and first["a"][1] == first["b"][1] != () and first["c"][1] == ()
    again = said(Engine(spark, path), T0 + timedelta(seconds=30))
    assert again == {k: ("hit", v[1]) for k, v in first.items()} and e.state.rows("answers") == 3
    assert {v[0] for v in said(e, T0 + timedelta(seconds=90)).values()} == {"stale"} and e.state.rows("answers") == 6
    assert e.evict_answers(T0 + timedelta(seconds=100), ttl=60) == 3 and e.state.rows("answers") == 3
    assert e.evict_answers(T0 + timedelta(seconds=100), ttl=60, most=1) == 2
    e.remember("fact number 7 is another one", "project", as_of=T0)
    assert {v[0] for v in said(e, T0 + timedelta(seconds=100)).values()} == {"miss"}
    assert e.evict_answers(T0 + timedelta(seconds=100), ttl=60) == 1  # of the facts before


def test_truncations_pruning_and_traces(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "m"))
    a = e.remember("we use the FastAPI framework", "project", as_of=T0)
    e.recall("framework", as_of=T0)
    assert e.touch(a, T0) and e.reinforce(a, as_of=T0) and not e.touch("no") and e.expire(T0) == 0
    e.flush()
    assert [r.operation for r in e.state.read("otel_spans").orderBy("timestamp").collect()] == ["store", "retrieve", "update", "update", "update", "delete"]
    e._span("store", 0.0)
    e.flush(keep=3)
    assert e.state.rows("otel_spans") == 3 == e.state.read("otel_spans").count() and e.state.read("otel_spans").where("timestamp = 0").count() == 0
    assert e.truncate("provenance") == 1 and e.truncate("otel_spans") == 3 and e.truncate("triggers_log") == 0
    assert e.clear("project") == 1 and e.clear() == 0
    seen = []
    e.remember("a fact on the parser of mail", "project")
    e.recall_by_model("parser for dev7@example.com", lambda p: seen.append(p) or "no json")
    assert "dev7@example.com" not in seen[0] and "[REDACTED_EMAIL]" in seen[0]


def test_model_clusters_without_a_window_by_layer(spark):
    from lamina.operators import tree

    f = facts(spark, 100).unionByName(facts(spark, 1, 200, "user"))
    made = tree.cluster_with_model(f, lambda p: "oops", size=4)
    rows = made.collect()
    sizes = {}
    for r in rows:
        sizes[r.layer, r.batch] = sizes.get((r.layer, r.batch), 0) + 1
    assert len(rows) == 101 and max(sizes.values()) <= 4
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number() windowspecdefinition(layer" in plan and "bin#" in plan.split("Window [row_number()")[1][:200]
