"""Rules inside a stream: changes between micro-batches, replays, broken files; and the query against plain Python."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lamina.functions import values as V
from lamina.plans import queries
from lamina.sources.derived import facts
from lamina.streaming.rules import Ruled, triggered, version_of

SCHEMA = "id string, layer string, content string, created_at timestamp_ntz"
DAY = datetime(2024, 1, 1)


def feed(spark, at, *rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")


def run(spark, at, sink):
    sink.start(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), f"{at}/stream").awaitTermination()


def made(sink):
    return {r.id: (r.expires_at and (r.expires_at - r.created_at).days, r.pinned, r.rules_version, r.batch) for r in sink.read().collect()}


def test_rules_change_between_batches(spark, tmp_path):
    at, file = str(tmp_path), tmp_path / "rules.toml"
    sink = Ruled(spark, str(file), f"{at}/out")
    feed(spark, at, ("a", "session", "x", DAY), ("b", "user", "my password", DAY), ("c", None, None, DAY), ("c2", "project", "", None))
    run(spark, at, sink)
    none = version_of("")
    first = {"a": (7, False, none, 0), "b": (90, True, none, 0), "c": (None, False, none, 0), "c2": (None, False, none, 0)}
    assert made(sink) == first
    text = '[forget]\nnever = ["moon"]\nafter_days = {session = 2}\n'
    file.write_text(text)
    feed(spark, at, ("d", "session", "the moon", DAY), ("e", "user", "my password", DAY))
    run(spark, at, sink)
    second = {"d": (2, True, version_of(text), 1), "e": (None, False, version_of(text), 1)}
    assert made(sink) == first | second
    file.write_text("[forget\nnever =")  # half written
    feed(spark, at, ("f", "session", "x", DAY))
    run(spark, at, sink)
    assert made(sink)["f"] == (2, False, version_of(text), 2)
    sink(spark.createDataFrame([("d", "session", "the moon", DAY), ("e", "user", "my password", DAY)], SCHEMA), 1)  # a replay
    file.write_text("[forget]\nnever = []\nafter_days = {}\n")
    sink(spark.createDataFrame([("a", "session", "x", DAY)], SCHEMA), 3)
    got = {(r.id, r.batch): r.rules_version for r in sink.read().collect()}
    assert got[("d", 1)] == got[("e", 1)] == version_of(text) and got[("a", 0)] == none and got[("a", 3)] == version_of(file.read_text()) and len(got) == 8


def test_triggers_of_a_batch(spark, tmp_path):
    file = tmp_path / "rules.toml"
    file.write_text('[triggers]\non_commit = "extract -> user"\n')
    sink = Ruled(spark, str(file), str(tmp_path / "out"), make=triggered)
    events = spark.createDataFrame([(1, "on_commit"), (2, "ON_"), (3, "nothing"), (4, None)], "n int, event string")
    sink(events, 0)
    sink(events.limit(0), 1)
    assert sorted((r.n, r.action) for r in sink.read().collect()) == [(1, "extract -> user"), (2, "extract -> user")]
    file.write_text("[triggers]\n")
    sink(events, 2)
    assert sink.read().where("batch = 2").count() == 0


def test_query_equals_plain_python(spark, sf):
    words = lambda text, never: any(w.lower() in text.lower() for w in never)
    got = {r.id: r for r in queries.rules_stream(spark, sf).collect()}
    rows = facts(spark, sf).collect()
    assert len(got) == len(rows)
    for r in rows:
        early = r.source in ("manual", "MCP", "external")
        ttl = (V.TTL_DAYS if early else {"session": 1, "project": 30}).get(r.layer)
        g = got[r.id]
        assert g.batch == (0 if early else 1) and (g.rules_version == version_of("")) == early
        assert g.expires_at == (ttl and f"{r.created_at + timedelta(days=ttl):%Y-%m-%d %H:%M:%S}")
        if not words(r.content, V.NEVER_FORGET if early else ("framework",)):
            assert not g.pinned
    assert {g.pinned for g in got.values()} == {True, False}
