"""Keyword retrieval of many queries at once, through an inverted token index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..sources.shared import meet
from . import tree

#: So many stems of queries are broadcast to the facts; more are shuffled with them.
FEW = 100_000


def token_rows(df: DataFrame, keys: list[str], text) -> DataFrame:
    """Distinct (keys, stem) of a text, for tables of few rows such as queries and node labels."""
    return df.select(*keys, F.explode(F.array_distinct(X.stems(text))).alias("stem")).distinct()


def words_of(facts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, head, stem) of every distinct word of a fact's content, and (head) of its first 60 characters, the leaf's title."""
    said = lambda text, head: F.transform(F.array_distinct(X.words(text)), lambda w: F.struct(w.alias("word"), F.lit(head).alias("head")))
    both = F.concat(said(F.col("content"), False), said(F.substring("content", 1, 60), True))
    words = facts.select(*keep, F.explode(both).alias("x")).select(*keep, "x.head", F.col("x.word").alias("word"))
    return X.stemmed(words, "word", "stem").drop("word")


def fact_tokens(facts: DataFrame) -> DataFrame:
    """The inverted index (id, stem, in_content, in_head): the head is the first 60 characters, the leaf's title."""
    return words_of(facts, ["id"]).groupBy("id", "stem").agg(F.max((~F.col("head")).cast("int")).alias("in_content"), F.max(F.col("head").cast("int")).alias("in_head"))


def label_hits(q: DataFrame, labels: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(query_id, keys, hits): stems of the query in a node's title plus those in its summary."""
    parts = labels.select(*keys, F.posexplode(F.array("title", "summary")).alias("part", "said"))
    return q.join(token_rows(parts, [*keys, "part"], F.col("said")), "stem").groupBy("query_id", *keys).agg(F.count("*").alias(name))


def scored(facts: DataFrame, queries: DataFrame, index: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(query_id, id, layer, content, confidence, score) of every pair with a score of 1 or more.

    queries has (query_id, query). A fact stands on three nodes, its layer, cluster and leaf,
    at depths 1 to 3; its score is the best of (label hits + 3 * content hits) * boost of the
    layer * confidence + 1 / (depth + 1) over the nodes with hits.

    With `best`, of the facts of a cluster that are hit by labels alone only the first `best` different contents by
    confidence and id are paired with a query: as their scores follow the confidence, no other can be among its best
    `best`. Without it every question that hits a layer's label meets all facts of the layer.
    """
    f = facts.select("id", F.coalesce("layer", F.lit("session")).alias("layer"), "content", F.coalesce("confidence", F.lit(0.5)).alias("confidence")).where("content is not null and content <> ''")
    q = token_rows(queries, ["query_id"], F.col("query"))
    small = q.limit(FEW + 1).count() <= FEW
    keys, rest = ["query_id", "id"], ["layer", "content", "confidence"]
    if index is None:
        words = words_of(f, ["id", *rest])
        met = meet(words, q.withColumnRenamed("stem", "asked"), words.stem.eqNullSafe(F.col("asked")), small).groupBy(*keys, *rest)  # a null-safe join pushes no copy of the stem below it
        content = met.agg(*[F.size(F.collect_set(F.when(x, F.col("stem")))).alias(c) for c, x in (("c", ~F.col("head")), ("h", F.col("head")))])
    else:
        content = meet(index, q, "stem", small).groupBy(*keys).agg(F.sum("in_content").cast("int").alias("c"), F.sum("in_head").cast("int").alias("h")).join(f.hint("merge"), "id").select(*keys, *rest, "c", "h")
    labels = tree.labels(facts)
    by_layer = label_hits(q, labels.where("grp is null"), ["layer"], "sl")
    by_cluster = label_hits(q, labels.where("grp is not null"), ["layer", "grp"], "sc")
    # Clusters follow from the content, so they are worked out after the aggregates, once for each content.
    if best is None:
        alone = tree.clustered(f)
    else:
        first = tree.clustered(f.groupBy("layer", "content").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "id")).alias("x")))
        rank = F.row_number().over(W.partitionBy("layer", "grp").orderBy("x.less", "x.id"))
        alone = first.withColumn("rank", rank).where(F.col("rank") <= max(1, best)).select("x.id", "layer", "grp", "content", (-F.col("x.less")).alias("confidence"))
    hit = by_layer.select("query_id", "layer", F.lit(None).cast("string").alias("g")).union(by_cluster.select("query_id", "layer", "grp"))
    same = F.expr("f.layer = t.layer and (t.g is null or t.g = f.grp)")
    alone, hit = alone.alias("f"), hit.alias("t")
    met = meet(hit, alone, same, True) if best is not None and best <= 1000 else meet(alone, hit, same, small)
    alone = met.select("query_id", *[f"f.{c}" for c in ("id", *rest)], F.lit(0).alias("c"), F.lit(0).alias("h"))
    rows = tree.clustered(content.unionByName(alone).groupBy(*keys, *rest).agg(F.max("c").alias("c"), F.max("h").alias("h")))
    rows = rows.join(by_layer, ["query_id", "layer"], "left").join(by_cluster, ["query_id", "layer", "grp"], "left")
    boost = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in V.BOOST.items()], F.lit(1.0))
    rows = rows.withColumns({"w": boost * F.col("confidence"), "sl": F.coalesce("sl", F.lit(0)), "sc": F.coalesce("sc", F.lit(0))})
    at = lambda s, d: F.when(s + 3 * F.col("c") > 0, (s + 3 * F.col("c")) * F.col("w") + F.lit(1.0 / (d + 1)))
    rows = rows.withColumn("score", F.greatest(at(F.col("sl"), 1), at(F.col("sc"), 2), at(F.col("h") + F.col("c"), 3)))
    return rows.where("score >= 1.0").select("query_id", "id", "layer", "content", "confidence", "score")


def keyword(facts: DataFrame, queries: DataFrame, top_k: int = 5, index: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, layer, content, confidence, score): the best top_k facts of each query that reach half of
    its best score, one of equal contents; ties by id. Every task keeps the best top_k of a query before the shuffle."""
    s = scored(facts, queries, index, max(1, top_k))
    one = s.groupBy("query_id", "content").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "layer", "confidence")).alias("x"))
    rows = one.select("query_id", "x.id", "x.layer", "content", "x.confidence", (-F.col("x.s")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= max(0, top_k)).withColumn("best", F.max("score").over(W.partitionBy("query_id")))
    return top.where("score >= 0.5 * best").select("query_id", "rank", "id", "layer", "content", "confidence", "score")


def results(facts: DataFrame, queries: DataFrame, top_k: int = 5, index: DataFrame | None = None) -> DataFrame:
    """One row for each query: facts, trace, confidence and sources; a query without keywords or hits has an empty result."""
    k = keyword(facts, queries, top_k, index)
    g = k.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "layer", "content", "confidence", "score"))).alias("sources"), F.round(F.least(F.avg("score") / 10, F.lit(1.0)), 2).alias("confidence"))
    keyed = token_rows(queries, ["query_id"], F.col("query")).select("query_id").distinct().withColumn("keyed", F.lit(True))
    out = queries.join(keyed, "query_id", "left").join(g, "query_id", "left")
    hit = F.col("sources").isNotNull()
    trace = F.when(F.col("keyed").isNull(), F.array(F.lit("no_keywords"))).when(~hit, F.array(F.lit("root"), F.lit("no_match"))).otherwise(F.array(F.lit("root"), F.lit("keyword_search"), F.col("sources")[0]["layer"]))
    return out.select("query_id", "query", F.when(hit, F.transform("sources", lambda s: s["content"])).otherwise(F.array().cast("array<string>")).alias("facts"), trace.alias("trace"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "sources")


def by_nodes(facts: DataFrame, nodes: DataFrame, chosen: DataFrame, top_k: int | None = 5) -> DataFrame:
    """Facts below the nodes that a model chose: chosen has (query_id, pos, node_id). Each fact once, at the first node that
    holds it, in the order of nodes and ids; the first top_k of each query, or all if it is None."""
    below = tree.members(nodes, chosen.select("node_id"))
    hit = chosen.join(below, "node_id").groupBy("query_id", "memory_id").agg(F.min("pos").alias("pos"))
    rows = hit.join(facts.where("content is not null and content <> ''"), F.col("memory_id") == F.col("id"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("pos", "id")))
    first = ranked if top_k is None else ranked.where(F.col("rank") <= max(0, top_k))
    return first.select("query_id", "rank", "id", "layer", "content", "confidence")


def chosen_nodes(replies: DataFrame) -> DataFrame:
    """(query_id, pos, node_id) from JSON replies {relevant_nodes: [...]}, each node once at its first place."""
    parsed = F.from_json("reply", "thinking string, relevant_nodes array<string>, confidence double")
    return replies.select("query_id", F.posexplode(parsed["relevant_nodes"]).alias("pos", "node_id")).groupBy("query_id", "node_id").agg(F.min("pos").alias("pos")).select("query_id", "pos", "node_id")


def naive(facts: DataFrame, expected: dict[str, list[str]], top_k: int = 3) -> DataFrame:
    """The baseline: for each query id its expected words; facts ranked by how many of them they contain, then by content."""
    low = F.lower("content")
    scores = [F.struct(F.lit(q).alias("query_id"), reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in words], F.lit(0)).alias("score")) for q, words in expected.items()]
    s = facts.select("id", "content", F.explode(F.array(*scores)).alias("x")).select("x.query_id", "id", "content", "x.score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("content"), "id"))
    return s.withColumn("rank", rank).where(F.col("rank") <= top_k)


def evaluate(found: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: retention (share of expected (query_id, id) pairs found), precision (share of found ones expected), answered."""
    right = found.join(expected, ["query_id", "id"], "left_semi")
    counts = found.agg(F.count("*").alias("found")).join(right.agg(F.count("*").alias("right"))).join(expected.agg(F.count("*").alias("wanted")))
    counts = counts.join(queries.join(found, "query_id", "left_semi").agg(F.count("*").alias("hit"))).join(queries.agg(F.count("*").alias("asked")))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.select(share("right", "wanted").alias("retention"), share("right", "found").alias("precision"), share("hit", "asked").alias("answered"))
