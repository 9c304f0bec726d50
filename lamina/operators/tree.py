"""The hierarchy root, layer, cluster, leaf as adjacency rows, and reading it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

NODE = ("node_id", "parent_id", "depth", "layer", "title", "summary", "n_memories", "confidence")


def clustered(facts: DataFrame) -> DataFrame:
    """facts with grp, the cluster, and no layer null; a column grp is replaced."""
    kept = [c for c in facts.columns if c not in ("grp", "layer")]
    low = facts.select(*kept, F.coalesce("layer", F.lit("session")).alias("layer"), F.lower("content").alias("grp"))
    return low.withColumn("grp", X.cluster_lowered(F.col("grp")))


def _mean():
    return F.coalesce(F.round(F.avg(F.coalesce("confidence", F.lit(1.0))), 2), F.lit(1.0)).alias("confidence")


def _layer_summary():
    return F.concat(F.col("n_memories").cast("string"), F.lit(" memories in layer '"), "layer", F.lit("'"))


def _cluster_summary():
    return F.concat(F.col("n_memories").cast("string"), F.lit(" memories about "), "grp")


def layers(facts: DataFrame) -> DataFrame:
    g = clustered(facts).groupBy("layer").agg(F.count("*").alias("n_memories"), _mean())
    return g.select(F.concat(F.lit("layer_"), "layer").alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1).alias("depth"), "layer", F.initcap("layer").alias("title"), _layer_summary().alias("summary"), "n_memories", "confidence")


def clusters(facts: DataFrame) -> DataFrame:
    g = clustered(facts).groupBy("layer", "grp").agg(F.count("*").alias("n_memories"), _mean())
    return g.select(
        F.concat(F.lit("cluster_"), "layer", F.lit("_"), "grp").alias("node_id"), F.concat(F.lit("layer_"), "layer").alias("parent_id"), F.lit(2).alias("depth"), "layer",
        X.cluster_title(F.col("grp")).alias("title"), _cluster_summary().alias("summary"), "n_memories", "confidence",
    )


def labels(facts: DataFrame) -> DataFrame:
    """(layer, grp, title, summary) of the layers (grp is null) and the clusters, from one aggregate."""
    g = clustered(facts).groupBy("layer", "grp").agg(F.count("*").alias("n_memories"))
    both = g.groupBy("layer").agg(F.sum("n_memories").alias("n_memories")).select("layer", F.lit(None).cast("string").alias("grp"), F.initcap("layer").alias("title"), _layer_summary().alias("summary"))
    return both.union(g.select("layer", "grp", X.cluster_title(F.col("grp")), _cluster_summary()))


def leaves(facts: DataFrame) -> DataFrame:
    c = clustered(facts)
    return c.select(
        F.concat(F.lit("mem_"), "id").alias("node_id"), F.concat(F.lit("cluster_"), "layer", F.lit("_"), "grp").alias("parent_id"), F.lit(3).alias("depth"), "layer",
        F.substring("content", 1, 60).alias("title"), F.col("content").alias("summary"), F.lit(1).cast("long").alias("n_memories"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def root(facts: DataFrame) -> DataFrame:
    g = clustered(facts).agg(F.countDistinct("layer").alias("l"), F.count("*").alias("n_memories"))
    said = F.concat(F.lit("Root node with "), F.col("l").cast("string"), F.lit(" layers, "), F.col("n_memories").cast("string"), F.lit(" total memories"))
    return g.select(
        F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit("root").alias("layer"), F.lit("Memory Root").alias("title"),
        F.when(F.col("n_memories") == 0, F.lit("Empty memory store")).otherwise(said).alias("summary"), "n_memories", F.lit(1.0).alias("confidence"),
    )


def build(facts: DataFrame) -> DataFrame:
    """All nodes. Inner nodes carry counts, not lists of ids: the ids of a node are those of the leaves below it."""
    return reduce(DataFrame.unionByName, [x(facts) for x in (root, layers, clusters, leaves)])


def rebuild_layer(nodes: DataFrame, facts: DataFrame, layer: str) -> DataFrame:
    """The tree with one layer built again from facts, and the root's summary with it."""
    fresh = build(facts.where(F.coalesce("layer", F.lit("session")) == layer)).where("depth > 0")
    return nodes.where((F.col("layer") != layer) & (F.col("depth") > 0)).unionByName(fresh).unionByName(root(facts))


def members(nodes: DataFrame, node_ids: DataFrame) -> DataFrame:
    """(node_id, memory_id) of the leaves at or below each of the named nodes: three joins, one for each level."""
    reach = node_ids.select(F.col("node_id").alias("top"), "node_id").distinct()
    out, edges = reach, nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("up"))
    for _ in range(3):
        reach = reach.join(edges, reach.node_id == edges.up).select("top", F.col("child").alias("node_id"))
        out = out.unionByName(reach)
    leaf = nodes.where("depth = 3").select("node_id")
    return out.join(leaf, "node_id", "left_semi").select(F.col("top").alias("node_id"), F.expr("substring(node_id, 5)").alias("memory_id")).distinct()


def stripped(nodes: DataFrame) -> DataFrame:
    """What may be shown outside: redacted titles and summaries, counts in place of ids."""
    return nodes.select("node_id", "parent_id", "depth", "layer", X.redact(F.col("title")).alias("title"), X.redact(F.col("summary")).alias("summary"), F.col("n_memories").alias("memory_count"))


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null"), "node_id", "left_anti")


def parse_clusters(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows (…, name, summary, memory_ids) from a model's JSON list of clusters, also inside a json fence; none if it is no list."""
    body = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col(reply))
    parsed = F.from_json(body, "array<struct<name:string,summary:string,memory_ids:array<string>>>")
    return df.withColumn("_c", F.explode(parsed)).select("*", "_c.name", "_c.summary", "_c.memory_ids").drop("_c")


def cluster_with_model(facts: DataFrame, model, size: int = 20) -> DataFrame:
    """(layer, batch, name, memory_id): clusters that `model` names for batches of `size` facts of a layer.

    model(prompt) -> str is a Python callable that executors can run. Ids that a batch does
    not hold, and clusters without ids, are dropped; a batch whose reply gives none falls back
    to the keyword clusters.
    """
    from pyspark.sql import Window as W

    # Facts are dealt by hash to bins of about 16 batches and numbered within a bin, so no task sees a whole layer.
    c = clustered(facts)
    bins = c.groupBy("layer").agg(F.ceil(F.count("*") / (16.0 * size)).alias("bins"))
    c = c.join(F.broadcast(bins), "layer").withColumn("bin", F.pmod(F.xxhash64("id", "content"), F.col("bins")).cast("int"))
    nth = F.row_number().over(W.partitionBy("layer", "bin").orderBy("id", "content")) - 1
    batch = F.concat_ws(".", F.col("bin").cast("string"), F.floor(nth / size).cast("string"))
    b = c.withColumn("batch", batch).select("layer", "batch", "id", "grp", X.redact(F.substring("content", 1, 200)).alias("shown"))

    def run(pdf):
        import json
        import re

        import pandas as pd

        prompt = "Group these memories; answer with a JSON list of {name, summary, memory_ids}.\n" + "\n".join(f"{i}: {s}" for i, s in zip(pdf["id"], pdf["shown"], strict=True))
        rows = []
        try:
            said = model(prompt)
            m = re.search(r"```(?:json)?\s*(.*?)```", said, re.S)
            known = set(pdf["id"])
            for x in json.loads(m[1] if m else said):
                rows += [(x["name"], i) for i in x.get("memory_ids", []) if i in known]
        except Exception:  # any failure of the model means the keyword clusters
            rows = []
        rows = rows or list(zip(pdf["grp"], pdf["id"], strict=True))
        return pd.DataFrame({"layer": pdf["layer"].iloc[0], "batch": pdf["batch"].iloc[0], "name": [r[0] for r in rows], "memory_id": [r[1] for r in rows]})

    return b.groupBy("layer", "batch").applyInPandas(run, "layer string, batch string, name string, memory_id string")
