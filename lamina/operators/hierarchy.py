"""Trees from rows of (node, parent), of any depth: resolution to roots, interval labels, tree order, nested documents.

Everything along a path is found by pointer doubling: in round k a row knows what lies 2^k steps above it, so a
tree of depth d takes log2(d) joins, whether it is a memory tree of four levels or a chain of thousands. A join
looks up one row for each pointer; many rows with one pointer (a parent of a third of all nodes) are a skewed left
side, which adaptive execution splits. Sums below a node are partial aggregates. Nothing is numbered by a window
over all rows or over the children of one node: rows are dealt by ranges of (parent, order), summed by range, and the
sums of the ranges, one row a partition, are the only thing that the driver sees. Joins of nodes are hinted to sort and
shuffle: by the size of its compressed file a table of millions of nodes is small enough to be broadcast.

A null or empty parent makes a root. Rows without an id are no nodes; of repeated ids the row with the smallest
parent counts. `status` is ok below a root, orphan at and below a node whose parent is not there, cycle
for nodes that no root and no orphan is above of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut


def climb(rows: DataFrame, combine: dict[str, Callable[[Column, Column], Column]], most: int | None = None) -> DataFrame:
    """Pointer doubling over rows (node, up, …) with unique nodes: combine[c](own, above) is c of the whole path, once `up` is null.

    Every non-null `up` must be a node. Rows still on a way after `most` rounds keep their `up`.
    """
    rows, done = cut(rows), 0
    while (most is None or done < most) and not rows.where("up is not null").isEmpty():
        above = rows.select(F.col("node").alias("_node"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in combine])
        moved = rows.where("up is not null").join(above.hint("merge"), F.col("up") == F.col("_node"))
        kept = [c for c in rows.columns if c not in combine and c != "up"]
        step = moved.select(*kept, F.col("_up").alias("up"), *[f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in combine.items()])
        rows, done = cut(rows.where("up is null").unionByName(step)), done + 1
    return rows


def resolve(nodes: DataFrame, id: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node, parent, root, depth, status): the root of every node and its distance; root and depth are null in a cycle."""
    up = F.when(F.col(parent).cast("string") != "", F.col(parent))
    once = nodes.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("node")).agg(F.min(up).alias("parent"))
    known = once.select(F.col("node").alias("_there"))
    first = once.join(known.hint("merge"), F.col("parent") == F.col("_there"), "left")
    top = F.col("_there").isNull()
    rows = first.select(
        "node", "parent", F.col("_there").alias("up"), F.when(top, F.col("node")).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), F.when(F.col("parent").isNull(), "ok").when(top, "orphan").alias("status")
    )
    rows = cut(rows)
    most = max(1, rows.count()).bit_length() + 1  # no path without a cycle is longer than 2^most
    rows = climb(rows, {"root": lambda own, above: above, "depth": lambda own, above: own + above, "status": lambda own, above: above}, most)
    free = F.col("up").isNull()
    return rows.select("node", "parent", F.when(free, F.col("root")).alias("root"), F.when(free, F.col("depth")).alias("depth"), F.coalesce(F.when(free, F.col("status")), F.lit("cycle")).alias("status"))


def one_root(nodes: DataFrame, id: str = "node_id", parent: str = "parent_id", root: str = "root", **columns: Column) -> DataFrame:
    """nodes, with a new root over the old ones if there are several; `columns` fill its other columns, else null. Its id gets underscores until it is free. Nodes of other types get ids of text."""
    name, top = root, F.coalesce(F.col(parent).cast("string"), F.lit("")) == ""
    if nodes.where(F.col(id).isNotNull() & top).select(id).distinct().limit(2).count() < 2:
        return nodes
    nodes = nodes.withColumns({id: F.col(id).cast("string"), parent: F.col(parent).cast("string")})
    while not nodes.where(F.col(id) == name).isEmpty():
        name = f"_{name}"
    fill = {id: F.lit(name), parent: F.lit(None)} | columns
    new = nodes.sparkSession.range(1).select([fill.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    return nodes.withColumn(parent, F.when(F.col(id).isNotNull() & top, F.lit(name)).otherwise(F.col(parent))).unionByName(new)


def sizes(rows: DataFrame) -> DataFrame:
    """(node, up, …, size): rows (node, up, …) with the number of nodes at and below each.

    After round k, `size` counts the nodes less than 2^k below, and `up` is 2^k above; those exactly 2^k below bring theirs.
    """
    base, at = rows, cut(rows.select("node", "up", F.lit(1).cast("long").alias("size")))
    while not at.where("up is not null").isEmpty():
        brought = at.where("up is not null").groupBy(F.col("up").alias("_node")).agg(F.sum("size").alias("_size"))
        above = at.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
        more = at.join(brought.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", "up", (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"))
        at = cut(more.join(above.hint("merge"), F.col("up") == F.col("_n"), "left").select("node", F.col("_up").alias("up"), "size"))
    return base.join(at.select("node", "size").hint("merge"), "node")


def running(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with `name`, the sum of `value` over all rows before, in the total order `order`: by ranges, then within each."""
    spark = rows.sparkSession
    dealt = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    upto, start = 0, []
    for p, n in sorted((r[0], r[1]) for r in dealt.groupBy("_p").agg(F.sum(value)).collect()):  # a row for each partition
        start.append((p, upto))
        upto += n
    offsets = spark.createDataFrame(start, "_p int, _start long")
    within = F.sum(value).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)
    return dealt.withColumn("_within", within).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + F.col("_within")).drop("_p", "_start", "_within")


def intervals(nodes: DataFrame, id: str = "node_id", parent: str = "parent_id", order: list[str] | None = None, label: str | None = None) -> DataFrame:
    """(node, parent, root, depth, enter, leave): nodes below roots in tree order, from 1. x is at or below y where x.enter is between y.enter and y.leave.

    Children (and roots) come by the columns `order`, then by id. With `label`, a column, path is the labels from the root, joined by /.
    """
    kept = [c for c in dict.fromkeys([*(order or []), *([label] if label else [])]) if c not in (id, parent)]
    more = nodes.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("node")).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"c_{c}") for c in kept]).drop("_n")
    if label in (id, parent):
        more = more.withColumn(f"c_{label}", F.col("node"))
    found = resolve(nodes, id, parent).where("status = 'ok'").drop("status").join(more.hint("merge"), "node").withColumn("up", F.col("parent"))
    sized = sizes(cut(found))
    by = [F.col("parent").asc_nulls_first(), *[F.col(f"c_{c}").asc_nulls_first() for c in order or []], F.col("node").asc()]
    placed = running(sized, by, "size", "before")
    least = placed.where("parent is not null").groupBy(F.col("parent").alias("_parent")).agg(F.min("before").alias("_first"))
    steps = placed.join(least.hint("merge"), F.col("parent") == F.col("_parent"), "left").withColumn("enter", F.col("before") - F.coalesce("_first", F.lit(0)) + 1)
    out, combine = ["node", "parent", "root", "depth", "enter", "size"], {"enter": lambda own, above: own + above}
    if label:
        steps = steps.withColumn("path", F.coalesce(F.col(f"c_{label}").cast("string"), F.lit("")))
        combine["path"] = lambda own, above: F.concat(above, F.lit("/"), own)
    got = climb(steps.select(*out, "up", *(["path"] if label else [])), combine)
    return got.select("node", "parent", "root", "depth", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"), *(["path"] if label else []))


def below(labelled: DataFrame, chosen: DataFrame, few: int = 10_000) -> DataFrame:
    """(top, node) for every node at or below each chosen node (a column node_id): a range join while there are at most `few` of them, else level by level."""
    tops = chosen.select(F.col("node_id").alias("_top")).where("_top is not null").distinct()
    if tops.limit(few + 1).count() <= few:
        reach = labelled.select(F.col("node").alias("_top"), F.col("enter").alias("_a"), F.col("leave").alias("_z")).join(F.broadcast(tops), "_top", "left_semi")
        return labelled.join(F.broadcast(reach), F.col("enter").between(F.col("_a"), F.col("_z"))).select(F.col("_top").alias("top"), "node")
    edges = labelled.select(F.col("node").alias("_node"), F.col("parent").alias("_up"))
    at = cut(labelled.join(tops, F.col("node") == F.col("_top")).select(F.col("_top").alias("top"), "node"))
    out = at
    while not at.isEmpty():
        at = cut(at.join(edges.hint("merge"), F.col("node") == F.col("_up")).select("top", F.col("_node").alias("node")))
        out = out.unionByName(at)
    return out


def lines(labelled: DataFrame, said: Column, indent: str = "  ") -> DataFrame:
    """(enter, line): the tree as indented lines; sorted by enter they are in tree order, so a sorted write needs no single task."""
    return labelled.select("enter", F.concat(F.repeat(F.lit(indent), F.col("depth").cast("int")), said).alias("line"))


def unnest(documents: DataFrame, json: str = "json", parent: str | None = None) -> DataFrame:
    """(node_id, parent_id, position, layer, title, summary, memory_ids, confidence) of nested documents {id, title, …, children: [...]}, one pass a level.

    A document's root has the parent that the column `parent` names, or none. What is not a document gives no row; a node without an id has a null one.
    """
    fields = "id string, layer string, title string, summary string, memory_ids array<string>, confidence double, children array<string>"
    at = documents.select(F.col(json).alias("j"), (F.col(parent).cast("string") if parent else F.lit(None).cast("string")).alias("parent_id"), F.lit(0).alias("position"))
    out = None
    while True:
        read = cut(at.withColumn("x", F.from_json("j", fields)).where("x is not null and (x.id is not null or x.title is not null)"))
        if out is not None and read.isEmpty():
            return out
        own = read.select(
            F.col("x.id").alias("node_id"), "parent_id", "position", "x.layer", "x.title", F.coalesce("x.summary", F.lit("")).alias("summary"),
            F.coalesce("x.memory_ids", F.array().cast("array<string>")).alias("memory_ids"), F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"),
        )
        out = own if out is None else out.unionByName(own)
        at = read.select(F.col("x.id").alias("parent_id"), F.posexplode("x.children").alias("position", "j"))


def nest(labelled: DataFrame, nodes: DataFrame, id: str = "node_id") -> DataFrame:
    """(root, json): each tree as one nested document {…, children: [...]}, put together from the deepest level up.

    A document holds its whole subtree, so it is as large as that; cut a forest into roots that fit a row first. nodes has (id, layer, title, summary, …).
    """
    kept = [c for c in ("layer", "title", "summary", "memory_ids", "confidence") if c in nodes.columns]
    rows = cut(labelled.select("node", "parent", "root", "depth", "enter").join(nodes.select(F.col(id).alias("node"), *kept).hint("merge"), "node"))
    deepest = rows.agg(F.max("depth")).first()[0]
    made = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = rows.where(F.col("depth") == d)
        if made is None:
            level = level.withColumn("children", F.lit("[]"))
        else:
            own = made.groupBy(F.col("parent").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("enter", "json"))), lambda c: c["json"]), ",").alias("c"))
            level = level.join(own.hint("merge"), F.col("node") == F.col("_p"), "left").withColumn("children", F.concat(F.lit("["), F.coalesce("c", F.lit("")), F.lit("]")))
        head = F.to_json(F.struct(F.col("node").alias("id"), *kept))
        made = level.withColumn("_h", head).select("parent", "root", "enter", F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"children":'), F.col("children"), F.lit("}")).alias("json"))
        made = cut(made) if d % 16 == 0 else made
    empty = labelled.select("root", F.lit("").alias("json")).where("false")
    return empty if made is None else made.select("root", "json")
