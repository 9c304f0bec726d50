"""The query catalogue: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import answers as A
from ..operators import consolidate as C
from ..operators import extract as E
from ..operators import hierarchy as H
from ..operators import lifecycle as L
from ..operators import provenance as P
from ..operators import reports as R
from ..operators import retrieve as Q
from ..operators import scopes as N
from ..operators import store as S
from ..operators import telemetry as O
from ..operators import tree as T
from ..sources import checkpoints as K
from ..sources.derived import AS_OF, adjacency, facts, read, scope_events, spans, triggers
from ..sources.shared import shared_dir, write_text_once
from ..streaming import rules as RS
from ..streaming import sessions as ST

ASKED = [
    ("q1", "which framework do we use"), ("q2", "fix the task"), ("q3", "decided to migrate"), ("q4", "what do I prefer"), ("q5", "team standup review"),
    ("q6", "session memories"), ("q7", "the and for"), ("q8", "zebra"), ("q9", "authentication database runtime dependency"), ("q10", "project decisions"),
]


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def asked(spark: SparkSession, n: int = len(ASKED)) -> DataFrame:
    return spark.createDataFrame(ASKED[:n], "query_id string, query string")


def _found(k: DataFrame) -> DataFrame:
    return k.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "layer", "content", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))


def retrieve_keyword(spark, sf):
    return _found(Q.keyword(facts(spark, sf), asked(spark, 1), 5))


def retrieve_batch(spark, sf):
    return _found(Q.keyword(facts(spark, sf), asked(spark), 10))


def retrieve_results(spark, sf):
    r = Q.results(facts(spark, sf), asked(spark), 3)
    return r.select("query_id", F.size("facts").cast("long").alias("n_facts"), F.array_join("trace", ">").alias("trace"), F.round("confidence", 2).alias("confidence"))


def retrieve_naive(spark, sf):
    n = Q.naive(facts(spark, sf), {"b1": ["framework", "brand"], "b2": ["migrate"]}, 3)
    return n.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.col("score").cast("long").alias("score"))


def tokenize_counts(spark, sf):
    w = X.words_in(read(spark, sf, "documents"), F.col("text"), "doc_id")
    per_doc = X.stemmed(w, "word", "stem").groupBy("doc_id", "stem").agg(F.count("*").alias("k"))
    return per_doc.groupBy("stem").agg(F.sum("k").alias("n"), F.count("doc_id").alias("n_docs"))


def stem_dictionary(spark, sf):
    return X.stemmed(X.words_in(read(spark, sf, "documents"), F.col("text")).distinct(), "word", "stem")


def redact_facts(spark, sf):
    f = facts(spark, sf)
    return f.select("id", X.redact(F.col("content")).alias("redacted"))


def secret_scan(spark, sf):
    return facts(spark, sf).select("id", X.has_secrets(F.col("content")).alias("found"), X.is_secret(F.col("content")).alias("secret"))


def pii_labels(spark, sf):
    return facts(spark, sf).select("id", F.array_join(X.pii_labels(F.col("content")), ",").alias("labels"))


def extract_patterns(spark, sf):
    e = E.by_pattern(facts(spark, sf))
    return e.select(F.col("key").alias("id"), F.col("line_no").cast("long").alias("line_no"), "content", "confidence", F.array_join("tags", ",").alias("tags"))


def extract_heuristic(spark, sf):
    e = E.by_marker(facts(spark, sf))
    return e.select(F.col("key").alias("id"), F.col("line_no").cast("long").alias("line_no"), "content", "confidence", F.array_join("tags", ",").alias("tags"))


def cluster_assign(spark, sf):
    return T.clustered(facts(spark, sf)).select("id", "layer", "grp")


def cluster_summary(spark, sf):
    return T.clusters(facts(spark, sf)).select("node_id", "title", "summary", "n_memories", "confidence")


def tree_nodes(spark, sf):
    return T.build(facts(spark, sf)).withColumns({"depth": F.col("depth").cast("long"), "parent_id": F.coalesce("parent_id", F.lit(""))})


def tree_incremental(spark, sf):
    f = facts(spark, sf)
    changed = f.withColumn("content", F.when(F.col("layer") == "user", F.concat(F.lit("we use "), "content")).otherwise(F.col("content")))
    return T.rebuild_layer(T.build(f), changed, "user").groupBy("layer", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"), F.sum("n_memories").alias("memories"))


def tree_descendants(spark, sf):
    n = T.build(facts(spark, sf))
    return T.members(n, n.where("depth < 3").select("node_id")).groupBy("node_id").agg(F.count("*").alias("n_leaves"))


def hierarchy_resolve(spark, sf):
    h = H.resolve(adjacency(spark, sf), "node", "parent")
    return h.select("node", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("root", "depth")], "status")


def hierarchy_intervals(spark, sf):
    return H.intervals(adjacency(spark, sf), "node", "parent", order=["name"]).select("node", "depth", "enter", "leave")


def tree_intervals(spark, sf):
    return H.intervals(T.build(facts(spark, sf)), order=["title"], label="node_id").select("node", "depth", "enter", "leave", "path")


def tree_lines(spark, sf):
    """The tree for a terminal: inner nodes by title, leaves shortened."""
    n = T.build(facts(spark, sf))
    label = F.when(F.col("depth") == 3, F.concat(F.lit("[mem] "), F.substring("title", 1, 50))).otherwise(F.concat(F.lit("[dir] "), "title", F.when(F.col("confidence") < 1, F.concat(F.lit(" (conf: "), F.round("confidence", 2).cast("string"), F.lit(")"))).otherwise("")))
    said = n.select(F.col("node_id").alias("node"), label.alias("said"))
    return H.lines(H.intervals(n, order=["title"]).join(said.hint("merge"), "node"), F.col("said"))


def tree_leaves(spark, sf):
    return T.leaf_nodes(T.build(facts(spark, sf))).select("node_id", "layer")


def tree_stripped(spark, sf):
    return T.stripped(T.build(facts(spark, sf))).select("node_id", "title", "summary", "memory_count")


def collect_nodes(spark, sf):
    f = facts(spark, sf)
    chosen = spark.createDataFrame([("a", 0, "cluster_project_team"), ("a", 1, "layer_user"), ("b", 0, "cluster_user_tasks"), ("b", 1, "cluster_user_tasks")], "query_id string, pos int, node_id string")
    return Q.by_nodes(f, T.build(f), chosen, None).select("query_id", F.col("rank").cast("long").alias("rank"), "id")


def list_layer(spark, sf):
    return S.newest(facts(spark, sf), "project", 50).select("id", "content", stamp("created_at"))


def below_confidence(spark, sf):
    return S.below_confidence(facts(spark, sf), 0.5, "session").select("id", "confidence")


def recent_triggers(spark, sf):
    return R.audit(triggers(spark, sf), 50).select("id", "event", "action", stamp("timestamp"), "n_memories")


def page_spans(spark, sf):
    return S.page(spans(spark, sf), 25, 50, trace_id="7").select("id", "operation", "timestamp")


def prune_spans(spark, sf):
    return S.prune(spans(spark, sf), 500)[1].select("id", "timestamp")


def store_stats(spark, sf):
    f = facts(spark, sf)
    return S.stats(memories=f, tree_nodes=T.build(f), triggers_log=triggers(spark, sf), otel_spans=spans(spark, sf))


def insert_redacted(spark, sf):
    f = facts(spark, sf)
    old, new = f.where("layer <> 'user'"), f.where("layer = 'user'").drop("source")
    return S.insert(old, new, now()).groupBy("layer", "source").agg(F.count("*").alias("n"), F.count_if(F.col("content").contains("[REDACTED_")).alias("redacted"))


def decay_apply(spark, sf):
    return L.decay(facts(spark, sf), 3)[1].select("memory_id", "layer", F.round("old_confidence", 6).alias("old_confidence"), F.round("new_confidence", 6).alias("new_confidence"))


def decay_on_read(spark, sf):
    """Confidence as of now from the time it was written at, each fact by its own elapsed days."""
    f = L.aged(facts(spark, sf), L.days_between(F.col("created_at"), now()))
    return f.select("id", "layer", F.round("confidence", 6).alias("confidence"))


def _questions(spark, sf) -> DataFrame:
    """Questions out of conversations: a turn's first words, for one of three layers or all."""
    c = read(spark, sf, "conversations")
    layer = F.element_at(F.array(F.lit("project"), F.lit("session"), F.lit("user"), F.lit(None)), (F.col("turn") % 4 + 1).cast("int"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.substring("text", 1, 12).alias("query"), layer.alias("layer"), (F.col("turn") % 2 * 5 + 5).cast("int").alias("top_k"), "conv_id", "turn")


def _answers(spark, sf) -> DataFrame:
    """Answers given to the questions of each second conversation, at facts of version 1 or 2, a minute apart."""
    q = _questions(spark, sf).where("conv_id % 2 = 0 and query is not null")
    version = F.when(F.col("conv_id") % 6 == 0, 1).otherwise(2).cast("long")
    at = (F.lit("2024-01-14 20:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("conv_id") % 240).cast("int")))
    return q.select(A.key(version).alias("key"), version.alias("version"), at.alias("answered_at"), F.concat(F.lit("answer of "), "query_id").alias("answer"))


def answers_split(spark, sf):
    got = A.split(_questions(spark, sf).drop("conv_id", "turn"), _answers(spark, sf), F.lit(2), now(), ttl=7200)
    return got.select("query_id", "status", F.coalesce("answer", F.lit("")).alias("answer"))


def answers_evicted(spark, sf):
    kept, gone = A.evict(_answers(spark, sf), now(), ttl=7200, most=40, version=F.lit(2))
    return gone.select("key", stamp("answered_at"), "reason", "answer").unionByName(kept.select("key", stamp("answered_at"), F.lit("kept").alias("reason"), "answer"))


def decay_flagged(spark, sf):
    return L.flagged(facts(spark, sf)).select("id", "layer", "confidence")


def reinforce(spark, sf):
    r = L.reinforce(facts(spark, sf), F.col("source") == "manual", now())
    return r.select("id", F.round("confidence", 6).alias("confidence"), stamp("created_at"))


def expire(spark, sf):
    kept, gone = L.expire(facts(spark, sf), now())
    return kept.groupBy("layer").agg(F.count("*").alias("n")).withColumn("state", F.lit("kept")).unionByName(gone.groupBy("layer").agg(F.count("*").alias("n")).withColumn("state", F.lit("expired")))


def should_forget(spark, sf):
    return facts(spark, sf).select("id", L.should_forget(now()).alias("forget"))


def expiry_compute(spark, sf):
    return facts(spark, sf).select("id", F.coalesce(F.date_format(L.expiry(F.col("layer"), F.col("created_at")), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("expires"))


def consolidate_layer(spark, sf):
    new, moved = C.move(facts(spark, sf), "session", "project")
    return new.groupBy("layer").agg(F.count("*").alias("n")).unionByName(moved.agg(F.count("*").alias("n")).withColumn("layer", F.lit("(moved)")))


def trigger_fire(spark, sf):
    m, log, _ = C.fire("on_", facts(spark, sf), triggers(spark, sf), now())
    return m.groupBy("layer").agg(F.count("*").alias("n")).unionByName(log.groupBy(F.col("event").alias("layer")).agg(F.count("*").alias("n")))


def trigger_match(spark, sf):
    rules = spark.createDataFrame(list(V.TRIGGERS.items()), "pattern string, action string")
    return C.match_rules(triggers(spark, sf).select("event").distinct().unionByName(spark.createDataFrame([("on_file",), ("nothing",)], "event string")), rules).select("event", "pattern", "action")


def last_activity(spark, sf):
    return C.last_activity(facts(spark, sf), triggers(spark, sf)).select(stamp("last_activity"))


def inactivity(spark, sf):
    later = F.lit(datetime(2030, 1, 1).isoformat(" ")).cast("timestamp_ntz")
    f, t = facts(spark, sf), triggers(spark, sf)
    return C.inactive(f, t, now()).select(F.lit("as_of").alias("at"), "inactive").unionByName(C.inactive(f, t, later).select(F.lit("later").alias("at"), "inactive"))


def session_summary(spark, sf):
    return C.summary(facts(spark, sf)).select("layer", "n", F.length("summary").cast("long").alias("chars"), F.md5(F.col("summary").cast("binary")).alias("md5"))


def reflection(spark, sf):
    m, log = C.reflect(facts(spark, sf), triggers(spark, sf), "manual", now(), "r1")
    fact = m.where("id = 'r1'").select("id", "layer", "confidence", F.md5(F.col("content").cast("binary")).alias("md5"))
    return fact.join(log.where("event = 'manual'").select(F.size("memories_affected").cast("long").alias("n_ids")))


def _records(spark, sf) -> DataFrame:
    q = asked(spark)
    f = facts(spark, sf)
    return P.record(Q.keyword(f, q, 5), q, now(), searched=0)


def provenance_report(spark, sf):
    return P.report(_records(spark, sf))


def provenance_breakdown(spark, sf):
    return P.breakdown(_records(spark, sf), "source_type")


def provenance_low_conf(spark, sf):
    return P.low_confidence(_records(spark, sf), 0.75).select("id", F.round("avg_confidence", 6).alias("avg_confidence"))


def provenance_imbalance(spark, sf):
    return P.imbalance(_records(spark, sf), 0.3)


def span_stats(spark, sf):
    return O.stats(spans(spark, sf))


def span_totals(spark, sf):
    return O.totals(spans(spark, sf))


def span_otlp(spark, sf):
    o = O.otlp(spans(spark, sf))
    return o.select("traceId", "spanId", "name", "startTimeUnixNano", "endTimeUnixNano", F.col("status.code").cast("long").alias("code"), F.size("attributes").cast("long").alias("n_attributes"))


def span_attributes(spark, sf):
    number = F.col("span_id").cast("int")
    s = spans(spark, sf).withColumns({"confidence": F.col("duration_ms") / 100, "top_k": number % 10, "query": F.when(number % 3 == 0, F.concat(F.lit("q"), "span_id"))})
    s = s.withColumn("attributes", F.when(number % 5 == 0, F.create_map(F.lit("gen_ai.memory.layer"), F.lit("own"), F.lit("extra"), F.col("operation"))))
    a = O.otlp(s).select("spanId", F.explode("attributes").alias("a")).select("spanId", "a.key", "a.value.*")
    return a.select("spanId", "key", *[F.coalesce(c, F.lit("")).alias(c) for c in ("stringValue", "intValue")], F.coalesce(F.round("doubleValue", 6), F.lit(-1.0)).alias("doubleValue"))


def span_invalid(spark, sf):
    s = spans(spark, sf).withColumn("confidence", F.col("duration_ms") / 100)
    return O.split_valid(s)[1].select("id")


def scope_counts(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("span"), F.col("turn").alias("at"), F.col("role").alias("operation"), F.lit(None).cast("string").alias("layer"))
    flat = F.array_join(F.transform(F.map_entries("by_operation"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return O.scope_counts(c).select("span", "n_operations", "first", "last", flat.alias("by_operation"))


def scope_spans(spark, sf):
    """Nested spans of all scopes as of the end of January; a scope is left after two days without an event."""
    s = N.completed(scope_events(spark, sf), idle=172_800, as_of=F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), bucket=86_400)
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    exact = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")).alias(c)
    return s.select("scope", "span", "name", F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("depth").cast("long").alias("depth"), exact("start"), exact("end"), "status", "n_operations", flat("by_operation"), flat("by_layer"))


def health_report(spark, sf):
    return R.health(facts(spark, sf), _records(spark, sf), spans(spark, sf), now())


def health_samples(spark, sf):
    return R.samples(facts(spark, sf), now()).withColumn("rank", F.col("rank").cast("long"))


def heatmap_layer(spark, sf):
    return R.heatmap(facts(spark, sf))


def heatmap_tags(spark, sf):
    return R.top_tags(facts(spark, sf))


def timeline(spark, sf):
    return R.timeline(facts(spark, sf), triggers(spark, sf), 20).select(F.col("rank").cast("long").alias("rank"), "kind", "id", stamp("at"), "what")


def checkpoint_latest(spark, sf):
    s = spans(spark, sf).withColumn("thread", F.concat(F.lit("checkpoint:"), "trace_id")).select("thread", "timestamp", F.col("span_id").cast("long").alias("span"))
    return R.latest_per(s.withColumn("o", F.struct("timestamp", "span")), "thread", "o", "checkpoint:").select("thread", "timestamp", "span")


def checkpoint_store(spark, sf):
    """Changes of clients put into a checkpoint store month by month, listed at the end; writes a store into a new folder."""
    c = read(spark, sf, "client_changes")
    text = K.content(F.struct("seq", "change_id", "segment", "city", "balance"), F.array("op"), F.struct("source"))
    rows = c.select(F.concat(F.lit("client-"), F.col("client_id").cast("string")).alias("thread"), F.col("valid_at").alias("created_at"), text.alias("content"), F.trunc("valid_at", "month").alias("month"), "seq", "change_id")
    store = K.Checkpoints(spark, f"{shared_dir(spark)}/checkpoints-{uuid.uuid4().hex}")
    for r in rows.select("month").distinct().orderBy(F.asc_nulls_first("month")).collect():  # a few months
        store.put(rows.where(F.col("month").eqNullSafe(F.lit(r.month))), order=("created_at", "seq", "change_id"))
    v = F.from_json("values", "segment string, city string, balance double")
    return store.list().select("thread", stamp("created_at"), F.get_json_object("metadata", "$.source").alias("source"), v["segment"].alias("segment"), v["city"].alias("city"), v["balance"].alias("balance"), F.col("next")[0].alias("next"))


def rules_stream(spark, sf):
    """Facts streamed in two micro-batches with the rules changed between them; writes into a new folder."""
    at = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    first = F.coalesce(F.col("source").isin("manual", "MCP", "external"), F.lit(True))
    f = facts(spark, sf).select("id", "layer", "content", "source", "created_at")
    sink = RS.Ruled(spark, f"{at}/rules.toml", f"{at}/out")
    for rows, text in ((f.where(first), None), (f.where(~first), '[forget]\nnever = ["framework"]\nafter_days = {session = 1, project = 30}\n')):
        if text is not None:
            write_text_once(spark, sink.rules, text)
        rows.write.mode("append").parquet(f"{at}/in")
        sink.start(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/stream").awaitTermination()
    return sink.read().select("id", "layer", stamp("expires_at"), "pinned", "rules_version", F.col("batch").cast("long").alias("batch"))


def last_turn_capture(spark, sf):
    t = R.last_turns(read(spark, sf, "conversations"))
    return t.select("conv_id", "turn", "role", X.redact(F.col("content")).alias("content"))


def sessionize(spark, sf):
    return ST.sessions(read(spark, sf, "events")).select("user_id", stamp("start"), stamp("end"), "n")


def window_counts(spark, sf):
    return ST.windowed(read(spark, sf, "events"), "1 day").select(stamp("start"), "event_type", "n", F.round("value", 4).alias("value"))


CATALOGUE = [
    retrieve_keyword, retrieve_batch, retrieve_results, retrieve_naive, tokenize_counts, stem_dictionary, redact_facts, secret_scan, pii_labels, extract_patterns, extract_heuristic, cluster_assign,
    cluster_summary, tree_nodes, tree_incremental, tree_descendants, hierarchy_resolve, hierarchy_intervals, tree_intervals, tree_lines, tree_leaves, tree_stripped, collect_nodes, list_layer, below_confidence, recent_triggers, page_spans, prune_spans, store_stats, insert_redacted,
    decay_apply, decay_on_read, answers_split, answers_evicted, decay_flagged, reinforce, expire, should_forget, expiry_compute, consolidate_layer, trigger_fire, trigger_match, last_activity, inactivity, session_summary, reflection, provenance_report,
    provenance_breakdown, provenance_low_conf, provenance_imbalance, span_stats, span_totals, span_otlp, span_attributes, span_invalid, scope_counts, scope_spans, health_report, health_samples, heatmap_layer, heatmap_tags, timeline,
    checkpoint_latest, checkpoint_store, rules_stream, last_turn_capture, sessionize, window_counts,
]
QUERIES = {f.__name__: f for f in CATALOGUE}
#: Queries that write files or streams: these have no SQL and are tested against brute force.
WRITERS = frozenset({"checkpoint_store", "rules_stream"})
