"""Batched model calls, with failures, bad replies and the way by keywords and patterns."""

import json
from datetime import datetime

from lamina.operators import dispatch as D
from lamina.plans.engine import Engine
from pyspark.sql import functions as F


def test_replies_keep_failures_in_their_rows(spark):
    def model(prompt):
        if int(prompt) % 3 == 0:
            raise ValueError("busy")
        return prompt * 2

    rows = spark.range(60).selectExpr("id as key", "if(id = 7, null, string(id)) as prompt")
    got = {r.key: (r.reply, r.error) for r in D.replies(rows, model).collect()}
    assert got == {k: (None, None) if k == 7 else (None, "ValueError: busy") if k % 3 == 0 else (str(k) * 2, None) for k in range(60)}
    assert D.replies(rows.limit(0), model).count() == 0


def test_recall_by_model(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    asked = spark.createDataFrame([(f"q{k}", f"which framework {k} password=hunter2{k}") for k in range(6)], "query_id string, query string")
    none = e.recall_many(asked, model=lambda p: "{}").collect()
    assert {(tuple(r.trace), r.confidence, len(r.facts)) for r in none} == {(("empty_tree",), 0.0, 0)} and len(none) == 6
    for text, layer in (("we use the FastAPI framework", "project"), ("prefer tabs over spaces", "user"), ("fix task 12 today", "session")):
        e.remember(text, layer, as_of=datetime(2024, 1, 1))

    def model(prompt):
        assert "hunter2" not in prompt and "layer_user" in prompt
        k = int(prompt.split("which framework ")[1][0])
        if k % 3 == 0:
            raise RuntimeError("down")
        return {1: json.dumps({"relevant_nodes": ["layer_user", "nowhere", "layer_user"], "confidence": 0.6}), 2: "no json", 4: json.dumps({"relevant_nodes": []}), 5: json.dumps({"relevant_nodes": ["nowhere"]})}[k]

    got = {r.query_id: r for r in e.recall_many(asked, 3, model=model).collect()}
    words = {r.query_id: r for r in e.recall_many(asked, 3).collect()}
    assert len(got) == 6 and got["q1"].method == "model" and got["q1"].facts == ["prefer tabs over spaces"] and got["q1"].confidence == 0.6 and got["q1"].trace[0] == "root" and len(got["q1"].trace) == 2
    assert (got["q5"].method, got["q5"].facts, got["q5"].trace, got["q5"].confidence) == ("model", [], ["root"], 0.8)
    for k in ("q0", "q2", "q3", "q4"):
        assert (got[k].method, got[k].facts, got[k].trace, got[k].confidence) == ("keyword", words[k].facts, words[k].trace, words[k].confidence)
    assert {k for k in got if got[k].error} == {"q0", "q3"}


def test_extract_by_model(spark, tmp_path):
    lines = "we decided to use Postgres for storage"
    texts = spark.createDataFrame([(k, "project", lines if k != "d" else None) for k in "abcd"], "id string, layer string, content string")
    texts = texts.withColumn("content", F.concat("content", F.lit(" "), "id"))

    def model(prompt):
        if prompt.endswith("a"):
            return json.dumps({"memories": [{"content": "storage is Postgres", "confidence": 0.95}, {"content": "x"}]})
        if prompt.endswith("b"):
            raise RuntimeError("down")
        return json.dumps({"memories": [{"content": "my password is here"}]})

    rows = D.extract(texts, model)
    got = {r.key: (r.source, r.content) for r in rows.collect()}
    assert got["a"] == ("llm_extract", "storage is Postgres") and rows.where("key = 'a'").count() == 1
    assert {got[k][0] for k in "bc"} == {"heuristic_extract"} and "d" not in got
    e = Engine(spark, str(tmp_path / "l"))
    e.learn(texts, model=model)
    assert e.memories().where("source = 'llm_extract'").count() == 1
