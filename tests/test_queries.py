"""Queries against their SQL, and the driver's contract."""

import __spark_entry__ as entry
from lamina.plans import oracle, queries
from pyspark.sql import functions as F

from tests.oracle_compare import compare


def test_every_query_has_sql():
    assert set(oracle.SQL) == set(queries.QUERIES) - queries.WRITERS


def test_queries_equal_sql(spark, sf):
    assert compare(spark, "/root/testdata/sf0.001", set(oracle.SQL)) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_flagship_plan(spark, sf):
    plan = entry.queries()["retrieve_batch"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_collect_nodes_has_no_limit(spark, tmp_path):
    n = 100_001
    part = spark.range(n).selectExpr("id * 3 + 2 as p_partkey", "'name' as p_name", "'brand' as p_brand", "'type' as p_type")
    part.write.parquet(str(tmp_path / "part.parquet"))
    ranks = {r.query_id: (r.n, r.last) for r in queries.collect_nodes(spark, str(tmp_path)).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()}
    assert ranks["a"] == (n, n)


def test_retrieval_compiles_and_scans_little(spark, sf):
    """No plan falls back from generated code, and a retrieval reads the facts a few times only."""
    from lamina.operators import retrieve

    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("retrieve_batch", "health_report", "tokenize_counts", "stem_dictionary", "cluster_summary"):
            queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
    plan = queries.QUERIES["retrieve_batch"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 8, plan.count("FileScan parquet")
    f, q = queries.facts(spark, sf), queries.asked(spark)
    want = sorted(map(tuple, retrieve.keyword(f, q, 10).collect()))
    assert sorted(map(tuple, retrieve.keyword(f, q, 10, retrieve.fact_tokens(f)).collect())) == want
    # The bounded pairs give the same best as all pairs.
    every = sorted((r.query_id, -r.score, r.id, r.content) for r in retrieve.scored(f, q).collect())
    for k in {r[0] for r in every}:
        seen, best = [], []
        for _, s, i, content in (r for r in every if r[0] == k):
            if content not in seen:
                seen.append(content)
                best.append((i, -s))
        assert [(r[2], r[6]) for r in sorted(want) if r[0] == k] == [(i, s) for i, s in best[:10] if s >= 0.5 * best[0][1]]


def test_facts_are_not_broadcast(spark, sf):
    """Few queries go to the words of facts, not these through the driver; nor do the ids of all facts."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().splitlines()
    for name in ("retrieve_keyword", "retrieve_batch", "retrieve_results", "provenance_report", "provenance_breakdown", "provenance_low_conf", "provenance_imbalance", "health_report"):
        lines = plan(queries.QUERIES[name](spark, sf))
        met = [x for x in lines if "Join" in x and "isnull(stem" in x]
        assert met and all("BuildRight" in x for x in met), (name, met)
    ids = [x for x in lines if "Join [id#" in x]
    assert ids and all("SortMergeJoin" in x for x in ids), ids


def _broadcast_rows(df):
    """Rows of every broadcast that the plan, as it was run, sent through the driver."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "BroadcastExchange":
            yield p.metrics().apply("numOutputRows").value()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
        for x in inner:
            yield from walk(x)

    return sorted(walk(df._jdf.queryExecution().executedPlan()))


def test_broadcasts_do_not_grow_with_facts(spark, sf, tmp_path):
    """Six times the facts: what retrieval and provenance broadcast stays the questions, the labels and the best few of each cluster."""
    part = queries.read(spark, sf, "part")
    n = part.agg(F.max("p_partkey")).first()[0] + 1
    copies = part.crossJoin(spark.range(6).withColumnRenamed("id", "i")).withColumn("p_partkey", F.col("p_partkey") + F.col("i") * n).drop("i")
    copies.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("retrieve_batch", "retrieve_results", "provenance_report"):  # the other reports are made of the same records
        small, large = (_broadcast_rows(queries.QUERIES[name](spark, at)) for at in (sf, str(tmp_path)))
        assert small and sum(large) <= 1.5 * sum(small) and sum(large) < part.count(), (name, small, large)


def test_many_queries_are_shuffled(spark, sf, monkeypatch):
    from lamina.operators import retrieve

    f, q = queries.facts(spark, sf).where("id like '%7'"), queries.asked(spark)
    rows = lambda: [sorted(map(tuple, df.collect())) for df in (retrieve.keyword(f, q, 10), retrieve.keyword(f, q, 10, retrieve.fact_tokens(f)), retrieve.scored(f, q))]
    want = rows()
    monkeypatch.setattr(retrieve, "FEW", 1)
    assert all(want) and rows() == want


def test_extraction_is_dealt_to_all_tasks(spark, sf):
    """Facts of one small file meet the patterns in many tasks, and are not joined with themselves for their layer."""
    from lamina.operators import extract

    f = queries.facts(spark, sf)
    assert f.rdd.getNumPartitions() < 8 <= extract.lines(f).rdd.getNumPartitions()
    for name in ("extract_patterns", "extract_heuristic"):
        assert "Join" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name
