"""The engine: state, rules and operators behind the calls that a program makes."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers, consolidate, dispatch, extract, lifecycle, provenance, reports, retrieve, store, telemetry, tree
from ..sources.config import Rules
from ..sources.shared import cut
from ..sources.state import State


class Cache:
    """Answers by (query, layer, top_k, version), for ttl seconds of the wall clock."""

    def __init__(self, ttl: float = 300, clock: Callable[[], float] = time.time):
        self.ttl, self.clock, self.held, self.hits, self.misses = ttl, clock, {}, 0, 0

    def get(self, key):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.ttl:
            self.misses += 1
            return None
        self.hits += 1
        return value

    def set(self, key, value) -> None:
        self.held[key] = (self.clock(), value)

    def clear(self) -> None:
        self.held.clear()

    def stats(self) -> dict:
        n = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "size": len(self.held), "hit_rate": self.hits / n if n else 0.0}


def traced(operation: str):
    """A method as one span, told by its name."""

    def of(method):
        @wraps(method)
        def call(self, *args, **kw):
            with self._within(operation, method=method.__name__):
                return method(self, *args, **kw)

        return call

    return of


class Engine:
    """Calls return plain values or DataFrames; as_of, where it matters, is explicit and is now if left out."""

    def __init__(self, spark: SparkSession, path: str, rules: Rules | None = None, cache_ttl: float = 300, service: str = "lamina", traced: bool = True):
        self.spark, self.state, self.rules, self.cache = spark, State(spark, path, aged={"memories": lifecycle.aged}), rules or Rules(), Cache(cache_ttl)
        self.service, self.traced, self.trace, self.pending, self.open = service, traced, uuid.uuid4().hex, [], threading.local()

    def memories(self, layer: str | None = None) -> DataFrame:
        m = self.state.read("memories")
        return m if layer is None else m.where(F.col("layer") == layer)

    def _now(self, as_of: datetime | None):
        return F.lit((as_of or datetime.now()).isoformat(" ")).cast("timestamp_ntz")

    @contextmanager
    def _within(self, operation: str, **known):
        """A span of what is done inside, also where it fails; calls inside it are its children. What the block gets may be added to.

        Spans wait for flush(), so a call costs no write of its own. Contents are not recorded.
        """
        if not self.traced:
            yield {}
            return
        stack = self.open.__dict__.setdefault("spans", [])  # of this thread
        began, span, parent, more = time.time(), uuid.uuid4().hex[:16], stack[-1] if stack else None, {}
        said = {"status": "ok"}
        stack.append(span)
        try:
            yield more
        except Exception as e:
            said = {"status": "error", "error_message": str(e)[:200]}
            raise
        finally:
            stack.pop()
            found = said | known | more
            attributes = {k: str(found.pop(k)) for k in ("method", "rows") if k in found} | ({telemetry.PARENT: parent} if parent else {})
            self._span(operation, began, span_id=span, **found | ({"attributes": attributes} if attributes else {}))

    def _span(self, operation: str, began: float, status: str = "ok", **known) -> None:
        if self.traced:
            self.pending.append({"id": uuid.uuid4().hex, "trace_id": self.trace, "span_id": uuid.uuid4().hex[:16], "operation": operation, "timestamp": began, "duration_ms": 1000 * (time.time() - began), "status": status, "service_name": self.service} | known)

    def _traced(self, operation: str, call: Callable, **known):
        with self._within(operation, **known):
            return call()

    def new_trace(self) -> str:
        """Spans from now on belong to a new trace; its id."""
        self.trace = uuid.uuid4().hex
        return self.trace

    def start_tracing(self) -> str:
        self.traced = True
        return self.new_trace()

    def stop_tracing(self) -> None:
        """Write the waiting spans and record no more."""
        self.flush()
        self.traced = False

    def flush(self, keep: int = 10_000) -> None:
        """Write the waiting spans and keep the newest."""
        if self.pending:
            rows = [tuple(p.get(f.name) for f in store.SPAN) for p in self.pending]
            self.state.append(otel_spans=self.spark.createDataFrame(rows, store.SPAN).coalesce(1))
            self.pending = []
            if self.state.rows("otel_spans") > keep:
                self.prune("otel_spans", keep)

    def prune(self, table: str = "otel_spans", keep: int = 10_000) -> int:
        """Delete all but the newest rows of spans or provenance; the number deleted."""
        return self.state.discard(table, lambda rows: store.prune(rows, keep, key="_place")[1])

    def truncate(self, table: str) -> int:
        """Delete all rows of the trigger log, provenance, spans or the tree; the number deleted."""
        return self._traced("delete", lambda: self.state.delete(table, F.lit(True)), method=f"truncate {table}")

    def remember(self, content: str, layer: str = "session", source: str = "manual", confidence: float = 1.0, tags=(), as_of: datetime | None = None, expire: bool = True) -> str:
        id = uuid.uuid4().hex
        now = self._now(as_of)
        new = self.spark.createDataFrame([(id, layer, content, source, float(confidence), list(tags))], "id string, layer string, content string, source string, confidence double, tags array<string>")
        if expire:
            new = new.withColumn("expires_at", lifecycle.expiry(F.col("layer"), now, self.rules.ttl_days))
        self._traced("store", lambda: self.state.append(memories=store.rows(new, now).coalesce(1)), memory_id=id, layer=layer if layer in ("project", "session", "user") else None)
        return id

    def learn(self, texts: DataFrame, as_of: datetime | None = None, markers: bool = False, model: Callable[[str], str] | None = None, parallel: int = 4) -> int:
        """Extract facts from (id, layer, content) texts, redacted first, and store them; with a model, by its replies where they hold facts."""
        with self._within("store", method="learn") as span:
            clean = texts.withColumn("content", X.redact(F.col("content")))
            found = dispatch.extract(clean, model, parallel, self.rules.never, self.rules.confidence) if model else extract.by_marker(clean, confidence=self.rules.confidence) if markers else extract.by_pattern(clean, never=self.rules.never, confidence=self.rules.confidence)
            now, seen = self._now(as_of), Observation()
            rows = store.rows(found.drop("key", "line_no").withColumn("expires_at", lifecycle.expiry(F.col("layer"), now, self.rules.ttl_days)), now)
            v = self.state.append(memories=rows.observe(seen, F.count(F.lit(1)).alias("rows")))
            span["rows"] = seen.get["rows"]  # of the job that wrote them
            return v

    def forget(self, id: str) -> bool:
        known = store.get(self.memories(), id).limit(1).count() > 0
        if known:
            self._traced("delete", lambda: self.state.delete("memories", F.col("id") == id), memory_id=id)
        return known

    def clear(self, layer: str | None = None) -> int:
        """The number of facts deleted."""
        return self._traced("delete", lambda: self.state.delete("memories", F.lit(True) if layer is None else F.col("layer") == layer), layer=layer if layer in ("project", "session", "user") else None)

    def _set(self, id: str, **columns) -> bool:
        return self._traced("update", lambda: self.state.update("memories", F.col("id") == id, **columns), memory_id=id)

    def set_layer(self, id: str, layer: str) -> bool:
        return self._set(id, layer=F.lit(layer))

    def set_confidence(self, id: str, confidence: float) -> bool:
        return self._set(id, confidence=F.lit(float(confidence)))

    def touch(self, id: str, as_of: datetime | None = None) -> bool:
        return self._set(id, created_at=self._now(as_of))

    def recall(self, query: str, top_k: int = 5, layer: str | None = None, as_of: datetime | None = None, record: bool = True) -> dict:
        """{facts, trace, confidence, sources}; recorded as provenance."""
        key = (query, layer, top_k, self.state.changed("memories"))  # new for each commit of facts, not of records
        if (held := self.cache.get(key)) is not None:
            return held
        m = self.memories(layer)
        q = self.spark.createDataFrame([(uuid.uuid4().hex, query)], "query_id string, query string")
        with self._within("retrieve", query=query, top_k=top_k) as span:
            row = retrieve.results(m, q, top_k).first()
            span |= {"results_count": len(row.facts), "confidence": row.confidence}
        out = {"facts": row.facts, "trace": row.trace, "confidence": row.confidence, "sources": [s.asDict() for s in row.sources or []]}
        if record:
            found = self.spark.createDataFrame([(row.query_id, s["rank"], s["id"], s["layer"], s["content"], s["confidence"]) for s in out["sources"]], "query_id string, rank int, id string, layer string, content string, confidence double")
            rec = provenance.record(found, self.spark.createDataFrame([(row.query_id, query)], "query_id string, query string"), self._now(as_of), searched=m.count())
            self.state.append(provenance=rec.coalesce(1))
        self.cache.set(key, out)
        return out

    def search(self, query: str, top_k: int = 5, layer: str | None = None) -> list[dict]:
        """Ranked facts with their scores; a span of the search, no provenance."""
        with self._within("search", query=query, top_k=top_k, layer=layer if layer in ("project", "session", "user") else None) as span:
            q = self.spark.createDataFrame([("q", query)], "query_id string, query string")
            found = [r.asDict() for r in retrieve.keyword(self.memories(layer), q, top_k).drop("query_id").collect()]
            span["results_count"] = len(found)
        return sorted(found, key=lambda r: r["rank"])

    def recall_many(self, queries: DataFrame, top_k: int = 5, layer: str | None = None, model: Callable[[str], str] | None = None, parallel: int = 4) -> DataFrame:
        """Answers of queries (query_id, query); with a model, that it calls on executors, by the nodes it names, else by keywords."""
        m = self.memories(layer)
        return retrieve.results(m, queries, top_k) if model is None else dispatch.recall(m, tree.build(m), queries, model, top_k, parallel)

    @traced("retrieve")
    def recall_stored(self, queries: DataFrame, top_k: int = 5, layer: str | None = None, as_of: datetime | None = None, ttl: float = 300.0) -> DataFrame:
        """(query_id, status, facts, trace, confidence) of queries (query_id, query): stored answers where there are fresh ones, the rest retrieved in one plan and stored for any engine on this state."""
        now, version = self._now(as_of), F.lit(self.state.changed("memories")).cast("long")
        asked = queries.select("query_id", "query", F.lit(layer).cast("string").alias("layer"), F.lit(top_k).alias("top_k"))
        met = cut(answers.split(asked, self.state.read("answers"), version, now, ttl))
        rest, kind = met.where("status <> 'hit'"), "facts array<string>, trace array<string>, confidence double"
        if not rest.isEmpty():
            found = retrieve.results(self.memories(layer), rest.select("query_id", "query"), top_k)
            made = cut(rest.select("query_id", "key", "status").join(found.select("query_id", F.to_json(F.struct("facts", "trace", "confidence")).alias("answer")), "query_id"))
            self.state.append(answers=made.dropDuplicates(["key"]).select("key", version.alias("version"), now.alias("answered_at"), "answer"))
            met = met.where("status = 'hit'").select("query_id", "status", "answer").unionByName(made.select("query_id", "status", "answer"))
        return met.withColumn("x", F.from_json("answer", kind)).select("query_id", "status", "x.facts", "x.trace", "x.confidence")

    def evict_answers(self, as_of: datetime | None = None, ttl: float = 300.0, most: int = 10_000) -> int:
        """Delete stored answers of older facts, older than ttl, superseded, or beyond the newest `most`; their number."""
        version = F.lit(self.state.changed("memories")).cast("long")
        return self.state.discard("answers", lambda rows: answers.evict(rows, self._now(as_of), ttl, most, version)[1])

    @traced("retrieve")
    def recall_by_model(self, query: str, model: Callable[[str], str], top_k: int = 5) -> dict:
        """A model sees the stripped inner nodes and names some; any failure, or no facts, means keyword retrieval."""
        m = self.memories()
        nodes = tree.build(m)
        try:
            shown = tree.stripped(nodes.where("depth < 3")).select(F.to_json(F.struct("*")).alias("j")).collect()
            asked = self.spark.range(1).select(X.redact(F.lit(query))).first()[0]
            said = model("Query: " + asked + "\n" + "\n".join(r.j for r in shown))
            chosen = retrieve.chosen_nodes(self.spark.createDataFrame([("q", said)], "query_id string, reply string"))
            rows = retrieve.by_nodes(m, nodes, chosen, top_k).orderBy("rank").collect()
        except Exception:  # the model is not ours
            rows = []
        if not rows:
            return self.recall(query, top_k)
        return {"facts": [r.content for r in rows], "trace": ["root"] + [r.layer for r in rows[:1]], "confidence": 0.8, "sources": [r.asDict() for r in rows]}

    @traced("update")
    def decay(self, days: float = 1, dry_run: bool = False) -> DataFrame:
        """The report of what changes. The days are recorded and no fact is written: reads age facts by what was recorded after them."""
        v = self.state.version()
        report = lifecycle.decay(self.state.read("memories", v), days)[1]
        if not dry_run:
            self.state.write(v, age={"memories": float(days)})
        return report

    @traced("update")
    def decay_if_due(self, min_hours: float = 24.0, as_of: datetime | None = None) -> bool:
        """Decay by the time since the last decay on record, if that is min_hours or more; whether a fact changed. The first call puts the time on record."""
        at = as_of or datetime.now()

        def change(v: int) -> int:
            last = self.state.record(v)["notes"].get("decayed_at")
            passed = (at - datetime.fromisoformat(last)).total_seconds() if last else 0.0
            if last and passed < min_hours * 3600:
                return 0
            days = passed / 86400
            report = lifecycle.decay(self.state.read("memories", v), days)[1]
            self.state.write(v, age={"memories": days} if days else None, note={"decayed_at": at.isoformat()})
            return int(days > 0 and not report.isEmpty())

        return bool(self.state.retried(change))

    def reinforce(self, id: str, amount: float = 0.1, as_of: datetime | None = None) -> bool:
        return self._set(id, confidence=F.least(F.col("confidence") + amount, F.lit(1.0)), created_at=self._now(as_of).cast("timestamp_ntz"))

    def expire(self, as_of: datetime | None = None) -> int:
        return self._traced("delete", lambda: self.state.delete("memories", lifecycle.expired(self._now(as_of))))

    @traced("update")
    def trigger(self, event: str, as_of: datetime | None = None) -> list[str]:
        m, log, ran = consolidate.fire(event, self.memories(), self.state.read("triggers_log"), self._now(as_of), self.rules.triggers)
        if ran:
            self.state.commit(memories=m, triggers_log=log)
        return ran

    @traced("update")
    def consolidate(self, source: str = "session", target: str = "project", event: str = "manual", as_of: datetime | None = None) -> int:
        m, log = consolidate.move_logged(self.memories(), self.state.read("triggers_log"), source, target, event, f"consolidate {source} -> {target}", self._now(as_of))
        return self.state.commit(memories=m, triggers_log=log)

    @traced("update")
    def reflect(self, force: bool = False, committed: Callable[[], bool] | None = None, summarise: Callable[[str], str] | None = None, as_of: datetime | None = None) -> str | None:
        """The event that led to reflection, or None."""
        now, m, log = self._now(as_of), self.memories(), self.state.read("triggers_log")
        event = consolidate.due(force, committed, m, log, now)
        if event and m.where("layer = 'session'").limit(1).count():
            m2, log2 = consolidate.reflect(m, log, event, now, uuid.uuid4().hex, summarise=summarise)
            self.state.commit(memories=m2, triggers_log=log2)
            return event
        return None

    def tree(self) -> DataFrame:
        """The stored tree, built again where the facts are newer than it."""
        record = self.state.record()["tables"]
        changed = lambda t: record.get(t, {"changed": 0})["changed"]
        if changed("tree_nodes") <= changed("memories"):
            self.state.commit(tree_nodes=tree.build(self.memories()))
        return self.state.read("tree_nodes")

    def health(self, as_of: datetime | None = None, threshold: float = 0.5) -> DataFrame:
        self.flush()
        return reports.health(self.memories(), self.state.read("provenance"), self.state.read("otel_spans"), self._now(as_of), threshold)

    def stats(self) -> dict[str, int]:
        return {r.table: r.rows for r in store.stats(**{t: self.state.read(t) for t in store.TABLES}).collect()}

    def timeline(self, limit: int = 20) -> DataFrame:
        return reports.timeline(self.memories(), self.state.read("triggers_log"), limit)

    def audit(self, limit: int = 50) -> DataFrame:
        return reports.audit(self.state.read("triggers_log"), limit)

    def span_stats(self) -> DataFrame:
        self.flush()
        return telemetry.stats(self.state.read("otel_spans"))
