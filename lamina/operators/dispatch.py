"""Questions to a language model for many rows at once, with patterns and keywords for what it doesn't answer.

model(prompt) -> str is a Python callable that executors can run. Each task makes up to `parallel` calls at a time. A call
that fails gives an error in its row, not a failed task. Replies are written to the shared folder before they are used, so the
branches of a plan see the same ones; a lost task asks again for its own rows alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..sources.shared import cut
from . import extract as E
from . import retrieve, tree

SOURCE = "array<struct<rank:int,id:string,layer:string,content:string,confidence:double>>"


def replies(prompts: DataFrame, model: Callable[[str], str], parallel: int = 4) -> DataFrame:
    """(key, reply, error) of prompts (key, prompt); the one that doesn't hold is null. A null prompt isn't asked and has both null."""

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        def ask(prompt):
            if prompt is None:
                return None, None
            try:
                return str(model(prompt)), None
            except Exception as e:  # the model is not ours
                return None, f"{type(e).__name__}: {e}"[:200]

        with ThreadPoolExecutor(parallel) as pool:
            for b in batches:
                said = list(pool.map(ask, b["prompt"]))
                yield b[["key"]].assign(reply=[r for r, _ in said], error=[e for _, e in said])

    rows = prompts.select("key", "prompt")
    return cut(rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, reply string, error string"))


def recall(facts: DataFrame, nodes: DataFrame, queries: DataFrame, model: Callable[[str], str], top_k: int = 5, parallel: int = 4) -> DataFrame:
    """(query_id, query, method, facts, trace, confidence, sources, error): one row for each of queries (query_id, query).

    The model is shown the redacted query and the inner nodes, and names nodes. Queries whose call failed, or whose reply is no JSON or names no
    node, go the keyword way. Nodes that don't exist hold no facts. Without facts the trace is `empty_tree`, and the model is not asked.
    """
    empty = F.array().cast("array<string>")
    if facts.isEmpty():
        return queries.select("query_id", "query", F.lit("none").alias("method"), empty.alias("facts"), F.array(F.lit("empty_tree")).alias("trace"), F.lit(0.0).alias("confidence"), F.array().cast(SOURCE).alias("sources"), F.lit(None).cast("string").alias("error"))
    # One row: inner nodes are layers and their clusters, whose names are fixed.
    shown = tree.stripped(nodes.where("depth < 3")).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("*")))), "\n").alias("shown"))
    ask = F.concat(F.lit("Name the nodes that hold what the query asks for, as JSON {relevant_nodes: [ids], confidence}.\nQuery: "), X.redact(F.col("query")), F.lit("\n"), F.col("shown"))
    said = replies(queries.join(shown).select(F.col("query_id").alias("key"), ask.alias("prompt")), model, parallel).withColumnRenamed("key", "query_id")
    chosen = cut(retrieve.chosen_nodes(said).where("node_id is not null"))
    sure = said.select("query_id", "error", F.coalesce(F.from_json("reply", "confidence double")["confidence"], F.lit(0.8)).alias("confidence"))
    source = F.struct("rank", "id", "layer", "content", "confidence")
    found = retrieve.by_nodes(facts, nodes, chosen, top_k).groupBy("query_id").agg(F.array_sort(F.collect_list(source)).cast(SOURCE).alias("sources"))
    titles = chosen.join(nodes.select("node_id", "title"), "node_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t"))
    # The path names those of the first three nodes that exist.
    first = chosen.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("pos")), 1, 3).alias("p"))
    path = F.transform(F.filter("t", lambda x: F.array_contains("p", x["pos"])), lambda x: x["title"])
    by_model = queries.join(first, "query_id").join(titles, "query_id", "left").join(found, "query_id", "left").join(sure, "query_id").select(
        "query_id", "query", F.lit("model").alias("method"), F.concat(F.array(F.lit("root")), F.coalesce(path, empty)).alias("trace"), "confidence", F.coalesce("sources", F.array().cast(SOURCE)).alias("sources"), "error"
    )
    rest = queries.join(chosen, "query_id", "left_anti")
    words = retrieve.results(facts, rest, top_k).join(sure.select("query_id", "error"), "query_id", "left")
    plain = F.transform("sources", lambda s: F.struct(*[s[c].alias(c) for c in ("rank", "id", "layer", "content", "confidence")])).cast(SOURCE)
    by_words = words.select("query_id", "query", F.lit("keyword").alias("method"), "trace", "confidence", F.coalesce(plain, F.array().cast(SOURCE)).alias("sources"), "error")
    return by_model.unionByName(by_words).withColumn("facts", F.transform("sources", lambda s: s["content"]))


def extract(texts: DataFrame, model: Callable[[str], str], parallel: int = 4, never=V.NEVER_FORGET, confidence=None) -> DataFrame:
    """(key, line_no, layer, content, source, confidence, tags) of texts (id, layer, content), which the caller has redacted.

    Facts out of the model's replies where one holds an acceptable fact; the other texts, failed calls included, go the pattern way.
    """
    levels = ", ".join(str(v) for v in sorted((V.CONFIDENCE | (confidence or {})).values()))
    ask = F.concat(F.lit(f"List the lasting facts of this text as JSON {{memories: [{{content, confidence, tags}}]}}; confidence is one of {levels}. No secrets, no personal data.\nLayer: "), "layer", F.lit("\n"), "content")
    said = replies(texts.select(F.col("id").alias("key"), ask.alias("prompt")), model, parallel)
    asked = texts.select(F.col("id").alias("key"), "layer").join(said, "key")
    known = cut(E.from_replies(asked, never=never, confidence=confidence, key="key"))
    rest = texts.join(known.select(F.col("key").alias("id")), "id", "left_anti")
    return known.withColumn("line_no", F.lit(None).cast("int")).unionByName(E.by_pattern(rest, never=never, confidence=confidence))
