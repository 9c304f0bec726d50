"""DuckDB SQL for the query catalogue, written from the values, not from our Spark expressions."""

from __future__ import annotations

from ..functions import values as V
from ..sources.derived import ADJACENCY, AS_OF, FACTS
from .queries import ASKED

TS = "(timestamp '2024-01-01 00:00:00' + to_minutes(p_partkey*17))"
FACT = FACTS.format(S="varchar", TS=TS, part="part")
NOW = f"timestamp '{AS_OF}'"
WORD = r"[\p{L}\p{N}_]{2,}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = ", ".join(lit(w) for w in V.STOP_WORDS)
SYNONYM = "case w " + " ".join(f"when {lit(a)} then {lit(b)}" for a, b in V.SYNONYMS.items()) + " else w end"
STEM = "case " + " ".join(f"when s like '%{a}' and length(s) > {len(a) + 2} then left(s, length(s) - {len(a)}) || '{b}'" for a, b in V.SUFFIXES) + " else s end"
GROUP = "case " + " ".join("when " + " or ".join(f"contains(lower(content), '{w}')" for w in words) + f" then '{g}'" for g, words in V.CLUSTERS) + " else 'other' end"
TITLE = "case grp when 'tech_stack' then 'Tech Stack' when 'decisions' then 'Decisions' when 'preferences' then 'Preferences' when 'tasks' then 'Tasks' when 'team' then 'Team' else 'Other' end"
CAPITAL = "upper(left(layer, 1)) || substr(layer, 2)"
ALL = V.SECRET_PATTERNS + V.PII_PATTERNS


def tokens(select: str, keys: str, distinct: bool = True) -> str:
    """Stems of the column t of a select, with its keys."""
    return f"select {'distinct ' * distinct}{keys}, {STEM} as stem from (select {keys}, {SYNONYM} as s from (select {keys}, unnest(regexp_extract_all(lower(t), {lit(WORD)})) as w from ({select})) where w not in ({STOP}))"


def redacted(c: str) -> str:
    for p, label in ALL:
        c = f"regexp_replace({c}, {lit(p)}, '[REDACTED_{label}]', 'gi')"
    return c


def any_of(c: str, patterns, flags: str = "i") -> str:
    return "(" + " or ".join(f"regexp_matches({c}, {lit(p)}{', ' + lit(flags) if flags else ''})" for p in patterns) + ")"


def holds(c: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({c}), {lit(w.lower())})" for w in words) + ")"


SECRET = any_of("content", [p for p, _ in ALL])
BASE = f"f as ({FACT}), fc as (select *, {GROUP} as grp from f)"
CONF = "coalesce(round(avg(confidence), 2), 1.0)"
NODES = f"""ln as (select 'layer_' || layer as node_id, 'root' as parent_id, 1 as depth, layer, {CAPITAL} as title, count(*) || ' memories in layer ''' || layer || '''' as summary, count(*) as n_memories, {CONF} as confidence from fc group by layer),
cn as (select 'cluster_' || layer || '_' || grp as node_id, 'layer_' || layer as parent_id, 2 as depth, layer, {TITLE} as title, count(*) || ' memories about ' || grp as summary, count(*) as n_memories, {CONF} as confidence, grp from fc group by layer, grp),
lf as (select 'mem_' || id as node_id, 'cluster_' || layer || '_' || grp as parent_id, 3 as depth, layer, left(content, 60) as title, content as summary, 1 as n_memories, confidence from fc),
rt as (select 'root' as node_id, '' as parent_id, 0 as depth, 'root' as layer, 'Memory Root' as title, 'Root node with ' || count(distinct layer) || ' layers, ' || count(*) || ' total memories' as summary, count(*) as n_memories, 1.0::double as confidence from fc),
nodes as (select * from rt union all select * from ln union all select * exclude (grp) from cn union all select * from lf)"""


def found(n: int, k: int) -> str:
    """CTEs that end in `top`: the k best facts of the first n questions."""
    asked = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in ASKED[:n])
    boost = "case layer " + " ".join(f"when '{a}' then {b}" for a, b in V.BOOST.items()) + " else 1.0 end"
    at = lambda s, d: f"case when {s} + 3*c > 0 then ({s} + 3*c) * ({boost}) * confidence + 1.0/{d + 1} else -1 end"
    return f"""with {BASE}, {NODES}, q(query_id, query) as (values {asked}),
qt as ({tokens("select query_id, query as t from q", "query_id")}),
mt as ({tokens("select id, content as t from f", "id")}), ht as ({tokens("select id, left(content, 60) as t from f", "id")}),
c as (select query_id, id, count(*) as c from qt join mt using (stem) group by all), h as (select query_id, id, count(*) as h from qt join ht using (stem) group by all),
lt as (select * from ({tokens("select layer, title as t from ln", "layer")}) union all select * from ({tokens("select layer, summary as t from ln", "layer")})),
ct as (select * from ({tokens("select layer, grp, title as t from cn", "layer, grp")}) union all select * from ({tokens("select layer, grp, summary as t from cn", "layer, grp")})),
sl as (select query_id, layer, count(*) as sl from qt join lt using (stem) group by all), sc as (select query_id, layer, grp, count(*) as sc from qt join ct using (stem) group by all),
x as (select q.query_id, query, id, layer, content, confidence, coalesce(c, 0) as c, coalesce(h, 0) as h, coalesce(sl, 0) as sl, coalesce(sc, 0) as sc from q cross join fc left join c using (query_id, id) left join h using (query_id, id) left join sl using (query_id, layer) left join sc using (query_id, layer, grp)),
s as (select *, greatest({at("sl", 1)}, {at("sc", 2)}, {at("h + c", 3)}) as score from x), ok as (select *, max(score) over (partition by query_id) as best from s where score >= 1.0),
one as (select *, row_number() over (partition by query_id, content order by score desc, id) as nth from ok where score >= 0.5 * best),
top as (select *, row_number() over (partition by query_id order by score desc, id) as rank from one where nth = 1 qualify rank <= {k})"""


LEVEL = lambda v: f"{float(v)}::double"


def extraction() -> str:
    """CTEs that end in `e`: accepted lines."""
    cols, picks = [], []
    for i, (p, g, level, tag) in enumerate(V.EXTRACTION):
        cols.append(f"trim(nullif(regexp_extract(line, {lit(p)}, {g}, 'i'), ''), '. ;,' || chr(9)) as c{i}")
        good = f"length(c{i}) >= 10 and not {holds(f'c{i}', V.NEVER_FORGET)} and not {any_of(f'c{i}', [x for x, _ in V.PII_PATTERNS], '')}"
        picks.append(f"when coalesce({good}, false) then {{'content': c{i}, 'level': '{level}', 'tag': '{tag}', 'confidence': {LEVEL(V.CONFIDENCE[level])}}}")
    return f"with {BASE}, l as (select id, layer, 0 as line_no, trim(content) as line from f where length(trim(content)) >= 10), p as (select *, {', '.join(cols)} from l), e as (select id, layer, line_no, case {' '.join(picks)} end as x from p)"


MARK = "case " + " ".join(f"when {any_of('content', ps)} then {LEVEL(V.CONFIDENCE[k])}" for k, ps in V.MARKERS) + " else 0.0 end"
RATE = "case layer " + " ".join(f"when '{k}' then {r}" for k, (r, _) in V.DECAY.items()) + " else 0.0 end"
FLOOR = "case layer " + " ".join(f"when '{k}' then {f}" for k, (_, f) in V.DECAY.items()) + " else 1.0 end"
SPANS = "sp as (select 's' || event_id as id, user_id::varchar as trace_id, event_id::varchar as span_id, case event_type when 'signup' then 'store' when 'view' then 'retrieve' when 'click' then 'search' when 'purchase' then 'update' when 'error' then 'delete' end as operation, floor(epoch(ts))::double as timestamp, value as duration_ms, case event_id % 4 when 0 then 'project' when 1 then 'session' when 2 then 'user' end as layer, case event_type when 'error' then 'error' else 'ok' end as status from events)"
TRIG = "tr as (select 't' || event_id as id, case event_type when 'signup' then 'on_commit' else 'on_session_end' end as event, case event_type when 'signup' then 'consolidate session -> project' else 'summarize session -> user' end as action, event_id % 3 + 1 as n_memories, ts as timestamp from events where event_type in ('signup', 'error'))"
FMT = "'%Y-%m-%d %H:%M:%S'"
KIND = "case when confidence >= 1.0 then 'explicit' when confidence >= 0.7 then 'inferred' else 'mentioned' end"
RECORDS = f"{found(len(ASKED), 5)}, src as (select query_id, id as memory_id, layer, confidence, {KIND} as source_type from top), rec as (select q.query_id as id, coalesce(avg(confidence), 0.0) as avg_confidence, 'keyword' as method from q left join src using (query_id) group by q.query_id)"
RULES = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in V.TRIGGERS.items())
TRUST = ", ".join(lit(t) for t in V.TRUSTED)
FIND = {"expired": f"coalesce(expires_at < {NOW}, false)", "low_confidence": "confidence < 0.5", "risky_source": f"lower(source) not in ({TRUST})", "secret_finding": SECRET}
NEVER = holds("content", V.NEVER_FORGET)
JOINED = "string_agg(content, '; ' order by created_at, id)"
FIRST = "select layer, content, min_by(created_at, (created_at, id)) as created_at, min_by(id, (created_at, id)) as id from f where content <> '' group by layer, content"

QUESTIONS = "qs as (select conv_id || '-' || turn as query_id, left(text, 12) as query, ['project', 'session', 'user', null][turn % 4 + 1] as layer, turn % 2 * 5 + 5 as top_k, conv_id from conversations)"
PARTS = "concat_ws('|', coalesce(length(query) || ':' || query, '-'), coalesce(length(layer) || ':' || layer, '-'), coalesce(length(top_k::varchar) || ':' || top_k, '-'), {v})"
ANSWERS = f"{QUESTIONS}, an as (select sha256({PARTS.format(v='version')}) as key, version, answered_at, 'answer of ' || query_id as answer from (select *, case when conv_id % 6 = 0 then 1 else 2 end as version, timestamp '2024-01-14 20:00:00' + to_minutes((conv_id % 240)::bigint) as answered_at from qs where conv_id % 2 = 0 and query is not null)), late as (select * from an qualify row_number() over (partition by key order by answered_at desc, version, answer) = 1), old as (select *, answered_at >= {NOW} - interval '7200' second as young from late)"
ADJACENT = f"with recursive adj as ({ADJACENCY.format(part='part')})"
#: Nodes below roots with the list of their order keys from the root; lists sort as the tree is walked.
WALK = "walk as (select node, parent, node as root, 0 as depth, [(name, node)] as keys from adj where parent is null union all select a.node, a.parent, w.root, w.depth + 1, list_append(w.keys, (a.name, a.node)) from adj a join walk w on a.parent = w.node)"
#: The same for the tree of facts, with paths of ids.
NODE_WALK = "walk as (select node_id as node, 0 as depth, [(title, node_id)] as keys, node_id as path from nodes where parent_id = '' union all select a.node_id, w.depth + 1, list_append(w.keys, (a.title, a.node_id)), w.path || '/' || a.node_id from nodes a join walk w on a.parent_id = w.node)"
NODE_UP = "up as (select node_id as node, parent_id as top from nodes where parent_id <> '' union all select u.node, n.parent_id from up u join nodes n on u.top = n.node_id where n.parent_id <> '')"
SIZED = "size as (select node, 1 + coalesce(n, 0) as n from walk left join (select top as node, count(*) as n from up group by top) using (node))"
ENTERED = "entered as (select *, row_number() over (order by keys) as enter from walk)"

SQL = {
    "retrieve_keyword": f"{found(1, 5)} select query_id, rank, id, layer, content, round(confidence, 6) as confidence, round(score, 6) as score from top",
    "retrieve_batch": f"{found(len(ASKED), 10)} select query_id, rank, id, layer, content, round(confidence, 6) as confidence, round(score, 6) as score from top",
    "retrieve_results": f"{found(len(ASKED), 3)}, g as (select query_id, count(*) as n, round(least(avg(score)/10, 1.0), 2) as confidence, min_by(layer, rank) as l from top group by query_id) select q.query_id, coalesce(n, 0) as n_facts, case when q.query_id not in (select query_id from qt) then 'no_keywords' when n is null then 'root>no_match' else 'root>keyword_search>' || l end as trace, coalesce(confidence, 0.0) as confidence from q left join g using (query_id)",
    "retrieve_naive": f"with {BASE}, s as (select 'b1' as query_id, id, content, contains(lower(content), 'framework')::bigint + contains(lower(content), 'brand')::bigint as score from f union all select 'b2', id, content, contains(lower(content), 'migrate')::bigint from f) select query_id, row_number() over (partition by query_id order by score desc, content desc, id) as rank, id, score from s qualify rank <= 3",
    "tokenize_counts": f"with t as ({tokens('select doc_id, text as t from documents', 'doc_id', False)}) select stem, count(*) as n, count(distinct doc_id) as n_docs from t group by stem",
    "stem_dictionary": f"select w as word, {STEM} as stem from (select w, {SYNONYM} as s from (select distinct unnest(regexp_extract_all(lower(text), {lit(WORD)})) as w from documents) where w not in ({STOP}))",
    "redact_facts": f"with {BASE} select id, {redacted('content')} as redacted from f",
    "secret_scan": f"with {BASE} select id, {SECRET} as found, ({NEVER} or {SECRET}) as secret from f",
    "pii_labels": f"with {BASE} select id, concat_ws(',', {', '.join(f'case when regexp_matches(content, {lit(p)}) then {lit(a)} end' for p, a in V.PII_PATTERNS)}) as labels from f",
    "extract_patterns": f"{extraction()} select id, line_no, x.content as content, x.confidence as confidence, layer || ',' || x.tag || ',' || x.level as tags from e where x is not null",
    "extract_heuristic": f"with {BASE} select id, 0 as line_no, content, {MARK} as confidence, layer || ',auto-extracted' as tags from (select id, layer, trim(content) as content from f) where length(content) >= 10 and {MARK} >= 0.5",
    "cluster_assign": f"with {BASE} select id, layer, grp from fc",
    "cluster_summary": f"with {BASE}, {NODES} select node_id, title, summary, n_memories, confidence from cn",
    "tree_nodes": f"with {BASE}, {NODES} select * from nodes",
    "tree_incremental": f"with f as (select * replace (case when layer = 'user' then 'we use ' || content else content end as content) from ({FACT})), fc as (select *, {GROUP} as grp from f), {NODES} select layer, depth, count(*) as n, sum(n_memories)::bigint as memories from nodes group by layer, depth",
    "tree_descendants": f"with {BASE} select 'root' as node_id, count(*) as n_leaves from fc union all select 'layer_' || layer, count(*) from fc group by layer union all select 'cluster_' || layer || '_' || grp, count(*) from fc group by layer, grp",
    "hierarchy_resolve": f"{ADJACENT}, top as (select node, node as root, 0 as depth, case when parent is null then 'ok' else 'orphan' end as status from adj where parent is null or parent not in (select node from adj) union all select a.node, t.root, t.depth + 1, t.status from adj a join top t on a.parent = t.node) select node, coalesce(root, -1)::bigint as root, coalesce(depth, -1)::bigint as depth, coalesce(status, 'cycle') as status from adj left join top using (node)",
    "hierarchy_intervals": f"{ADJACENT}, {WALK}, up as (select node, parent as top from walk where parent is not null union all select u.node, w.parent from up u join walk w on u.top = w.node where w.parent is not null), {SIZED}, {ENTERED} select node, depth::bigint as depth, enter, enter + n - 1 as leave from entered join size using (node)",
    "tree_intervals": f"with recursive {BASE}, {NODES}, {NODE_WALK}, {NODE_UP}, {SIZED}, {ENTERED} select node, depth::bigint as depth, enter, enter + n - 1 as leave, path from entered join size using (node)",
    "tree_lines": f"with recursive {BASE}, {NODES}, {NODE_WALK}, {ENTERED} select enter, repeat('  ', e.depth) || case when e.depth = 3 then '[mem] ' || left(title, 50) else '[dir] ' || title || case when confidence < 1 then ' (conf: ' || confidence::varchar || ')' else '' end end as line from entered e join nodes on node = node_id",
    "tree_leaves": f"with {BASE} select 'mem_' || id as node_id, layer from f",
    "tree_stripped": f"with {BASE}, {NODES} select node_id, {redacted('title')} as title, {redacted('summary')} as summary, n_memories as memory_count from nodes",
    "collect_nodes": f"with {BASE}, h as (select 'a' as query_id, id, min(case when layer = 'project' then 0 else 1 end) as pos from fc where (layer = 'project' and grp = 'team') or layer = 'user' group by id union all select 'b', id, 0 from fc where layer = 'user' and grp = 'tasks') select query_id, row_number() over (partition by query_id order by pos, id) as rank, id from h",
    "list_layer": f"with {BASE} select id, content, strftime(created_at, {FMT}) as created_at from (select * from f where layer = 'project' order by created_at desc, id limit 50)",
    "below_confidence": f"with {BASE} select id, confidence from f where layer = 'session' and confidence < 0.5",
    "recent_triggers": f"with {TRIG} select id, event, action, strftime(timestamp, {FMT}) as timestamp, n_memories from (select * from tr order by timestamp desc, id limit 50)",
    "page_spans": f"with {SPANS} select id, operation, timestamp from sp where trace_id = '7' order by timestamp desc, id limit 25 offset 50",
    "prune_spans": f"with {SPANS} select id, timestamp from sp where id not in (select id from sp order by timestamp desc, id limit 500)",
    "store_stats": f"with {BASE}, {NODES}, {TRIG} select 'memories' as \"table\", count(*) as rows from f union all select 'tree_nodes', count(*) from nodes union all select 'triggers_log', count(*) from tr union all select 'otel_spans', count(*) from events",
    "insert_redacted": f"with {BASE}, x as (select layer, case when layer = 'user' then 'manual' else source end as source, case when layer = 'user' then {redacted('content')} else content end as content from f) select layer, source, count(*) as n, count(*) filter (contains(content, '[REDACTED_')) as redacted from x group by layer, source",
    "decay_apply": f"with {BASE}, d as (select id, layer, confidence as o, case when {FLOOR} >= 1 or confidence >= 1 or {RATE} <= 0 then confidence else greatest(confidence * pow(1 - {RATE}, 3), {FLOOR}) end as n from f) select id as memory_id, layer, round(o, 6) as old_confidence, round(n, 6) as new_confidence from d where n <> o",
    "decay_on_read": f"with {BASE}, d as (select *, greatest(epoch_us({NOW}) - epoch_us(created_at), 0) / 86400000000.0::double as days from f) select id, layer, round(case when {FLOOR} >= 1 or confidence >= 1 or {RATE} <= 0 or days <= 0 then confidence else greatest(confidence * pow(1 - {RATE}, days), {FLOOR}) end, 6) as confidence from d",
    "answers_split": f"with {ANSWERS}, k as (select query_id, sha256({PARTS.format(v='2')}) as key from qs) select query_id, case when young is null then 'miss' when young then 'hit' else 'stale' end as status, case when young then answer else '' end as answer from k left join old using (key)",
    "answers_evicted": f"with {ANSWERS}, kept as (select key, answered_at from old where young and version = 2 order by answered_at desc, key limit 40) select an.key, strftime(an.answered_at, {FMT}) as answered_at, case when o.key is null or o.answered_at <> an.answered_at then 'superseded' when an.version <> 2 then 'version' when not young then 'age' when k.key is null then 'size' else 'kept' end as reason, an.answer from an left join old o on o.key = an.key and o.answered_at = an.answered_at left join kept k on k.key = an.key",
    "decay_flagged": f"with {BASE} select id, layer, confidence from f where confidence < {FLOOR}",
    "reinforce": f"with {BASE} select id, round(case when source = 'manual' then least(confidence + 0.1, 1.0) else confidence end, 6) as confidence, strftime(case when source = 'manual' then {NOW} else created_at end, {FMT}) as created_at from f",
    "expire": f"with {BASE} select layer, count(*) as n, case when {FIND['expired']} then 'expired' else 'kept' end as state from f group by all",
    "should_forget": f"with {BASE} select id, case when {NEVER} or layer not in ('session', 'user') then false else {FIND['expired']} end as forget from f",
    "expiry_compute": f"with {BASE} select id, coalesce(strftime(case layer when 'session' then created_at + interval '7' day when 'user' then created_at + interval '90' day end, {FMT}), '') as expires from f",
    "consolidate_layer": f"with {BASE} select case layer when 'session' then 'project' else layer end as layer, count(*) as n from f group by 1 union all select '(moved)', count(*) from f where layer = 'session'",
    "trigger_fire": f"with {BASE}, {TRIG} select case layer when 'session' then 'project' else layer end as layer, count(*) as n from f group by 1 union all select event, count(*) from tr group by event union all select 'on_', 1",
    "trigger_match": f"with {TRIG}, r(pattern, action) as (values {RULES}), e as (select distinct event from tr union all values ('on_file'), ('nothing')) select event, pattern, action from e join r on contains(lower(pattern), lower(event))",
    "last_activity": f"with {BASE}, {TRIG} select strftime(max(t), {FMT}) as last_activity from (select created_at as t from f union all select timestamp from tr)",
    "inactivity": f"with {BASE}, {TRIG}, m as (select max(t) as t from (select created_at as t from f union all select timestamp from tr)) select 'as_of' as at, t < {NOW} - interval '2' hour as inactive from m union all select 'later', t < timestamp '2030-01-01 00:00:00' - interval '2' hour from m",
    "session_summary": f"with {BASE}, o as ({FIRST}), g as (select layer, count(*) as n, {JOINED} as s from o group by layer) select layer, n, length(s) as chars, md5(s) as md5 from g",
    "reflection": f"with {BASE}, o as ({FIRST}), g as (select {JOINED} as content from o where layer = 'session') select 'r1' as id, 'project' as layer, 0.9::double as confidence, md5('Session reflection (manual): ' || {redacted('content')}) as md5, (select count(*) + 1 from f where layer = 'session') as n_ids from g",
    "provenance_report": f"{RECORDS} select 'all' as kind, '' as name, (select count(*) from rec) as n, coalesce(round(avg(confidence), 6), 0) as avg_confidence from src union all select 'layer', layer, count(*), round(avg(confidence), 6) from src group by layer union all select 'source_type', source_type, count(*), round(avg(confidence), 6) from src group by source_type union all select 'method', method, count(*), round(avg(avg_confidence), 6) from rec group by method",
    "provenance_breakdown": f"{RECORDS} select query_id as record_id, source_type, count(*) as n from src group by all",
    "provenance_low_conf": f"{RECORDS} select id, round(avg_confidence, 6) as avg_confidence from rec where avg_confidence < 0.75",
    "provenance_imbalance": f"{RECORDS}, g as (select source_type, count(*) as n, (select count(*) from src) as total from src group by source_type) select source_type, n, total, round(n / total, 6) as ratio from g where n / total > 0.3 order by ratio desc limit 1",
    "span_stats": f"with {SPANS} select 'all' as kind, '' as name, count(*) as n, round(sum(duration_ms), 3) as duration_ms, count(*) filter (status = 'error') as errors from sp union all select 'operation', operation, count(*), round(sum(duration_ms), 3), count(*) filter (status = 'error') from sp group by operation union all select 'layer', layer, count(*), round(sum(duration_ms), 3), count(*) filter (status = 'error') from sp where layer is not null group by layer",
    "span_totals": f"with {SPANS} select count(*) as total_spans, round(sum(duration_ms), 3) as total_duration_ms, round(avg(duration_ms), 3) as avg_duration_ms, count(*) filter (status = 'error') as error_count, round(count(*) filter (status = 'error') / count(*), 4) as error_rate from sp",
    "span_otlp": f"with {SPANS} select trace_id as traceId, span_id as spanId, 'gen_ai.memory.' || operation as name, (timestamp::bigint * 1000000000)::varchar as startTimeUnixNano, (timestamp::bigint * 1000000000 + trunc(duration_ms * 1000000)::bigint)::varchar as endTimeUnixNano, case status when 'ok' then 1 else 2 end as code, case when layer is null then 3 else 4 end as n_attributes from sp",
    "span_attributes": f"""with {SPANS}, r as (select *, span_id::bigint % 5 = 0 as own from sp), a as (
  select span_id, 'gen_ai.system' as key, 'lamina' as s, '' as i, -1.0::double as d from r
  union all select span_id, 'gen_ai.memory.operation', operation, '', -1 from r
  union all select span_id, 'gen_ai.memory.backend', 'spark', '', -1 from r
  union all select span_id, 'gen_ai.memory.layer', case when own then 'own' else layer end, '', -1 from r where own or layer is not null
  union all select span_id, 'extra', operation, '', -1 from r where own
  union all select span_id, 'gen_ai.memory.confidence', '', '', round(duration_ms / 100, 6) from r where duration_ms is not null
  union all select span_id, 'gen_ai.memory.top_k', '', (span_id::bigint % 10)::varchar, -1 from r
  union all select span_id, 'gen_ai.memory.query', 'q' || span_id, '', -1 from r where span_id::bigint % 3 = 0)
select span_id as spanId, key, s as stringValue, i as intValue, d as doubleValue from a""",
    "span_invalid": f"with {SPANS} select id from sp where duration_ms / 100 < 0 or duration_ms / 100 > 1",
    "scope_counts": "with c as (select conv_id, role, count(*) as n from conversations group by all), b as (select conv_id, count(*) as n, min(turn) as a, max(turn) as z from conversations group by conv_id) select b.conv_id as span, b.n as n_operations, a as first, z as last, (select string_agg(role || '=' || c.n, ',' order by role) from c where c.conv_id = b.conv_id) as by_operation from b",
    "scope_spans": f"""with ev as (select user_id::varchar as scope, ts as "at", event_id as seq, case event_type when 'signup' then 'open' when 'purchase' then 'close' else 'operation' end as kind,
   case event_type when 'view' then 'retrieve' when 'click' then 'search' when 'error' then 'delete' end as operation, case when event_type in ('view', 'click', 'error') then case event_id % 4 when 0 then 'project' when 1 then 'session' when 2 then 'user' end end as layer
  from events where user_id is not null and ts is not null and event_id is not null and event_type is not null),
 g as (select *, case when "at" - lag("at") over w <= interval '2' day then 0 else 1 end as fresh from ev window w as (partition by scope order by "at", seq)),
 r as (select *, sum(fresh) over (partition by scope order by "at", seq) as run from g),
 s as (select *, sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over (partition by scope, run order by "at", seq) as net, max("at") over (partition by scope, run) as last_at from r),
 d as (select *, net - least(0, min(net) over (partition by scope, run order by "at", seq)) as depth from s),
 o as (select *, lead(seq) over w as next_seq, lead("at") over w as next_at from d where kind = 'open' window w as (partition by scope, run, depth order by "at", seq)),
 c as (select o.scope, o.seq, min_by(k."at", (k."at", k.seq)) as closed from o join d k on k.scope = o.scope and k.run = o.run and k.kind = 'close' and k.depth = o.depth - 1 and (k."at", k.seq) > (o."at", o.seq) group by all),
 p as (select o.scope, o.seq, max_by(u.seq, (u."at", u.seq)) as parent from o join o u on u.scope = o.scope and u.run = o.run and u.depth = o.depth - 1 and (u."at", u.seq) < (o."at", o.seq) group by all),
 m as (select k.scope, max_by(o.seq, (o."at", o.seq)) as span, k.operation, k.layer, k.seq from d k join o on k.scope = o.scope and k.run = o.run and k.kind = 'operation' and k.depth = o.depth and (k."at", k.seq) > (o."at", o.seq) group by all),
 n as (select scope, span, count(*) as n from m group by all),
 bo as (select scope, span, string_agg(operation || '=' || n, ',' order by operation) as t from (select scope, span, operation, count(*) as n from m where operation is not null group by all) group by all),
 bl as (select scope, span, string_agg(layer || '=' || n, ',' order by layer) as t from (select scope, span, layer, count(*) as n from m where layer is not null group by all) group by all),
 f as (select o.*, c.closed, p.parent, case when c.closed is not null then 'closed' when timestamp '2024-01-31 00:00:00' - last_at > interval '2' day then 'abandoned' else 'active' end as status
  from o left join c using (scope, seq) left join p using (scope, seq))
select f.scope, f.seq as span, 'task ' || (f.seq % 7) as name, coalesce(f.parent, -1) as parent, f.depth::bigint as depth, strftime(f."at", '%Y-%m-%d %H:%M:%S.%f') as start,
 coalesce(strftime(case f.status when 'closed' then f.closed when 'abandoned' then last_at end, '%Y-%m-%d %H:%M:%S.%f'), '') as "end", f.status, coalesce(n.n, 0) as n_operations, coalesce(bo.t, '') as by_operation, coalesce(bl.t, '') as by_layer
from f left join n on n.scope = f.scope and n.span = f.seq left join bo on bo.scope = f.scope and bo.span = f.seq left join bl on bl.scope = f.scope and bl.span = f.seq""",
    "health_report": f"{RECORDS}, m as (select count(*) as memory_count, {', '.join(f'count(*) filter ({c}) as {k}_count' for k, c in FIND.items())} from f), {SPANS}, ls as (select * from sp), z as (select m.*, (select count(distinct memory_id) from src) as covered_memories, (select count(*) from rec) as provenance_records, (select count(*) from rec where avg_confidence < 0.5) as low_confidence_retrievals, (select count(*) from ls) as spans, (select count(*) from ls where status = 'error') as error_spans from m), y as (select *, round(covered_memories / memory_count, 6) as coverage, concat_ws(',', case when expired_count > 0 then 'expired' end, case when low_confidence_count > 0 then 'low_confidence' end, case when risky_source_count > 0 then 'risky_sources' end, case when secret_finding_count > 0 then 'secret_findings' end, case when provenance_records = 0 then 'missing_provenance' when covered_memories / memory_count < 0.5 then 'low_provenance_coverage' end, case when error_spans > 0 then 'otel_errors' end) as warnings from z) select *, case warnings when '' then 'ok' else 'warn' end as status from y",
    "health_samples": f"with {BASE}, h as ({' union all '.join(f'select {lit(k)} as category, * from f where {c}' for k, c in FIND.items())}) select category, row_number() over (partition by category order by created_at desc, id) as rank, id, layer, source, left(content, 120) as preview from h qualify rank <= 5",
    "heatmap_layer": f"with {BASE} select layer, count(*) as n, round(100 * count(*) / (select count(*) from f), 4) as percent from f group by layer",
    "heatmap_tags": f"with {BASE}, t as (select layer as tag from f union all select source from f) select tag, count(*) as n from t group by tag order by n desc, tag limit 10",
    "timeline": f"""with {BASE}, {TRIG}, u as (select * from (select 'memory' as kind, id, created_at as "at", left(content, 60) as what from f order by created_at desc, id limit 20) union all select * from (select 'trigger', id, timestamp, action from tr order by timestamp desc, id limit 20)) select row_number() over (order by "at" desc, kind, id) as rank, kind, id, strftime("at", {FMT}) as "at", what from u qualify rank <= 20""",
    "checkpoint_latest": f"with {SPANS} select 'checkpoint:' || trace_id as thread, timestamp, span_id::bigint as span from sp qualify row_number() over (partition by trace_id order by timestamp desc, span_id::bigint desc) = 1",
    "last_turn_capture": f"with l as (select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1) select conv_id, turn, role, {redacted('left(text, 500)')} as content from l where length(text) > 20",
    "sessionize": f"with g as (select user_id, ts, case when ts >= lag(ts) over w + interval '2' hour or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), {FMT}) as start, strftime(max(ts) + interval '2' hour, {FMT}) as \"end\", count(*) as n from s group by user_id, k",
    "window_counts": f"select strftime(date_trunc('day', ts), {FMT}) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
}
