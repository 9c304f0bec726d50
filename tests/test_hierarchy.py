"""Trees of any depth against plain walks."""

import json
import random

from pyspark.sql import functions as F

from lamina.operators import hierarchy as H


def plain(rows):
    """{node: (root, depth, status)} by walking up."""
    up, out = dict(rows), {}
    for n in up:
        seen, at = [], n
        while at in up and up[at] not in (None, "") and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            out[n] = (None, None, "cycle")
        elif at in up:
            out[n] = (at, len(seen), "ok")
        else:
            out[n] = (seen[-1], len(seen) - 1, "orphan")
    return out


def test_deep_chain_cycle_orphans_and_roots(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(1000)]  # a chain of 1,000
    rows += [("r2", ""), ("r2a", "r2"), ("x", "gone"), ("y", "x"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("tail", "c1"), ("self", "self")]
    df = spark.createDataFrame([*rows, ("n7", "n999"), (None, "r2")], "node_id string, parent_id string")  # a repeated id, a null one
    got = {r.node: (r.root, r.depth, r.status) for r in H.resolve(df).collect()}
    assert got == plain(rows)
    shown = {r.node: (r.enter, r["leave"]) for r in H.intervals(df).collect()}
    assert len(shown) == 1002 and shown["n0"] == (1, 1000) and shown["n999"] == (1000, 1000) and shown["r2"] == (1001, 1002) and shown["r2a"] == (1002, 1002)


def test_intervals_equal_a_walk(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 40 == 0 else rng.choice([i - 1, i - i % 40, rng.randrange(i - i % 40, i)]), rng.choice("abc")) for i in range(200)]
    rows += [(1000 + i, 0, "z") for i in range(300)]  # one parent of most nodes
    df = spark.createDataFrame(rows, "node_id long, parent_id long, name string")
    kids, n, want = {}, 0, {}
    for i, p, name in rows:
        kids.setdefault(p, []).append((name, i))

    def walk(i, path):
        nonlocal n
        n += 1
        enter, path = n, [*path, name_of[i]]
        for _, k in sorted(kids.get(i, [])):
            walk(k, path)
        want[i] = (enter, n, "/".join(path))

    name_of = {i: name for i, _, name in rows}
    for _, k in sorted(kids[None]):
        walk(k, [])
    labelled = H.intervals(df, order=["name"], label="name")
    assert {r.node: (r.enter, r["leave"], r.path) for r in labelled.collect()} == want
    chosen = spark.createDataFrame([(0,), (41,), (77,)], "node_id long")
    inside = {(t, x) for t in (0, 41, 77) for x in want if want[t][0] <= want[x][0] <= want[t][1]}
    for few in (10, 1):  # by ranges, and level by level
        assert {(r.top, r.node) for r in H.below(labelled, chosen, few).collect()} == inside


def test_empty(spark):
    df = spark.createDataFrame([], "node_id string, parent_id string")
    assert H.resolve(df).collect() == [] and H.intervals(df).collect() == [] and H.nest(H.intervals(df), df).collect() == []
    assert H.one_root(df).collect() == []


def test_several_roots_get_one(spark):
    df = spark.createDataFrame([("root", None, "A"), ("b", "", "B"), ("c", "b", "C")], "node_id string, parent_id string, title string")
    one = H.one_root(df, title=F.lit("Memory Tree"))
    assert {(r.node_id, r.parent_id, r.title) for r in one.collect()} == {("_root", None, "Memory Tree"), ("root", "_root", "A"), ("b", "_root", "B"), ("c", "b", "C")}
    assert H.one_root(one).collect() == one.collect()


def test_documents_to_rows_and_back(spark):
    leaf = {"id": "l1", "title": "leaf", "layer": "project", "summary": "leaf summary", "memory_ids": ["m1"], "confidence": 0.8, "children": []}
    deep = {"id": "d0", "title": "t", "layer": "user", "summary": "", "memory_ids": [], "confidence": 1.0, "children": []}
    for i in range(1, 6):
        deep = {"id": f"d{i}", "title": "t", "layer": "user", "summary": "", "memory_ids": [], "confidence": 1.0, "children": [deep]}
    root = {"id": "r1", "title": "root", "layer": "root", "summary": "root summary", "memory_ids": [], "confidence": 1.0, "children": [leaf, deep]}
    docs = spark.createDataFrame([(json.dumps(root),), ("no document",), (None,)], "json string")
    rows = H.unnest(docs)
    assert {(r.node_id, r.parent_id, r.position) for r in rows.collect()} >= {("r1", None, 0), ("l1", "r1", 0), ("d5", "r1", 1), ("d0", "d1", 0)}
    (made,) = H.nest(H.intervals(rows, order=["position"]), rows).collect()
    assert json.loads(made.json) == root


def test_nodes_are_not_broadcast(spark, monkeypatch):
    """No round of pointer doubling or sizes sends all nodes through the driver; only the sums of ranges are broadcast."""
    plans, cut = [], H.cut
    said = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(H, "cut", lambda df: plans.append(said(df)) or cut(df))
    df = spark.range(64).selectExpr("id as node_id", "case when id % 16 > 0 then id - 1 end as parent_id", "'n' as name")
    plans.append(said(H.intervals(df, order=["name"])))
    joins = [x.strip() for p in plans for x in p.splitlines() if "Join" in x]
    assert sum("SortMergeJoin" in x for x in joins) > 10 and all("SortMergeJoin" in x or "[_p#" in x for x in joins), joins
