"""Checkpoints: put, get and list against plain rows; which files a put writes; puts at the same time."""

import os
import tempfile
import threading
import zlib
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lamina.plans import queries
from lamina.sources.checkpoints import Checkpoints

DAY = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    return Checkpoints(spark, tempfile.mkdtemp(prefix="lamina-cp-"), buckets=8)


def rows(spark, *items):
    return spark.createDataFrame([(t, at, text, 1) for t, at, text in items], "thread string, created_at timestamp_ntz, content string, bucket int")


def test_put_get_list(spark, store):
    store.put(rows(spark, ("a", DAY, '{"values": {"x": 1}, "next": ["n"], "metadata": {"step": "1"}}'), ("a", DAY.replace(day=2), '{"values": {"x": 2}}'), ("b", None, "no JSON"), (None, DAY, "{}"), ("c", DAY, "[1]")))
    one = store.get("a").first()
    assert (one.thread, one["values"], one.next, one.metadata, one.parent_config, one.tasks) == ("checkpoint:a", '{"x":2}', [], "{}", None, [])
    assert store.get("b", "c", "zz").count() == 0 and store.get(None).first().thread == "checkpoint:default"
    store.put(rows(spark, ("a", DAY, '{"values": {"x": 3}, "metadata": {"step": "3"}, "parent_config": {"p": 1}, "tasks": ["t"]}')))  # older, but put later
    one = store.get("a").first()
    assert (one["values"], one.parent_config, one.tasks) == ('{"x":3}', '{"p":1}', ["t"]) and store.read().count() == 4
    assert [r.thread for r in store.list().collect()] == ["checkpoint:a", "checkpoint:default"]
    assert [r.thread for r in store.list(limit=1).collect()] == ["checkpoint:a"] and store.list(before=F.lit(DAY)).count() == 0
    assert [r.thread for r in store.list(having={"step": "3"}).collect()] == ["checkpoint:a"] and store.list(having={"step": "1"}).count() == 0
    assert [r["values"] for r in store.get_all(rows(spark, ("a", None, None), ("a", None, None))).collect()] == ['{"x":3}']
    assert store.read(1).where("thread = 'checkpoint:a'").first().content == '{"values": {"x": 2}}'  # old versions stay


def test_a_put_writes_its_buckets_only(spark, store):
    assert store.put(rows(spark)) == 0 and store.read().count() == 0
    store.put(rows(spark, *[(f"t{i}", DAY, "{}") for i in range(100)]))
    before = store.folders()
    assert len(before) == 8
    store.put(rows(spark, ("t5", DAY, '{"next": ["x"]}'), ("t5", DAY, '{"next": ["w"]}')))
    after = store.folders()
    assert [b for b in after if after[b] != before[b]] == [zlib.crc32(b"checkpoint:t5") % 8]
    assert store.read().count() == 100 and store.get("t5").first().next == ["x"]
    assert sum(len([f for f in os.listdir(f"{store.state.path}/{x}") if f.endswith(".parquet")]) for x in after.values()) == 8
    assert store.buckets() == 8 and Checkpoints(spark, store.state.path, buckets=3).get("t7").count() == 1


def test_puts_at_the_same_time_all_land(spark, store):
    store.put(rows(spark, ("t0", DAY, "{}")))
    failed = []

    def run(i):
        try:
            store.put(rows(spark, *[(f"w{i}-{k}", DAY, "{}") for k in range(3)]))
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed and {r.thread for r in store.read().collect()} == {"checkpoint:t0", *(f"checkpoint:w{i}-{k}" for i in range(4) for k in range(3))}


def test_query_equals_the_newest_change_of_each_client(spark, sf):
    got = {(r.thread, str(r.created_at), r.source, r.segment, r.city, r.balance, r.next) for r in queries.checkpoint_store(spark, sf).collect()}
    newest = duckdb.sql(f"""
        select 'checkpoint:' || coalesce('client-' || client_id, 'default'), coalesce(strftime(valid_at, '%Y-%m-%d %H:%M:%S'), 'None'), source, segment, city, balance, op from '{sf}/client_changes.parquet'
        qualify row_number() over (partition by client_id order by valid_at desc nulls last, seq desc nulls last, change_id desc) = 1""").fetchall()
    assert got == set(newest) and len(got) == len(newest)
