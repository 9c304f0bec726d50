"""DuckDB SQL for the queries that SQL can express, from the definitions, not from the methods: plain pairs and whole windows."""

from __future__ import annotations

from .secrets import THRESHOLD, WINDOW, WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Tail of a statement that has links(a, b) in both directions: reach(node, low), the smallest node reachable from each.
REACH = """closure(node, other) as (
  select a, b from links
  union
  select c.node, l.b from closure c join links l on c.other = l.a
),
reach as (select node, least(node, min(other)) as low from closure group by node)"""


def _matches(name: str, pattern: str, kind: str, order: int, keep: str) -> str:
    """A relation (doc_id, start, ord, kind, stop, hit): a match starts after all gaps and matches before it."""
    p = _quoted(pattern)
    return f"""{name} as (
  select doc_id, start, {order} as ord, '{kind}' as kind, start + length(hit) as stop, hit from (
    select doc_id, hits[k] as hit, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) as start
    from (select doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) as k from (
      select doc_id, regexp_extract_all(body, {p}) as hits, regexp_split_to_array(body, {p}) as gaps from bodies where regexp_matches(body, {p})))
  ) where {keep})"""


ASSIGN = f"(?i:{WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Public forms as whole patterns: UUIDs, numbers with separators, words and short numbers between separators, camel case.
FORMS = (
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[0-9+/_-]+",
    "[+/_-]*([A-Z]?[a-z]*|[A-Z]+|[0-9]{1,8})([+/_-]+([A-Z]?[a-z]*|[A-Z]+|[0-9]{1,8}))*", "[+/_-]*([A-Z]?[a-z]{2,}[+/_-]*)+",
)
PUBLIC = " or ".join(f"regexp_full_match(hit, {_quoted(p)})" for p in FORMS)

OP2 = f"""
with bodies as (select doc_id as key, row_number() over () as doc_id, coalesce(text, '') as body from documents),
{_matches("assigned", ASSIGN, "assign", 0, f"length(regexp_extract(hit, {_quoted(ASSIGN)}, 1)) >= 6")},
{_matches("access", "AKIA[A-Z0-9]+", "access", 1, "length(hit) >= 20")},
{_matches("hexes", "[0-9a-f]+", "hex", 2, "length(hit) >= 24")},
{_matches("runs", "[A-Za-z0-9+/_-]+", "run", 3, f"length(hit) >= {WINDOW} and not ({PUBLIC})")},
base as (select * from assigned union all select * from access union all select * from hexes),
free as (select r.*, regexp_full_match(r.hit, '[0-9a-fA-F]+') as is_hex from runs r where not exists (select 1 from base b where b.doc_id = r.doc_id and b.start <= r.start and b.stop >= r.stop)),
windows as (select doc_id, start, is_hex, hit, unnest(range(0, length(hit) - {WINDOW} + 1)) as i from free),
good as (
  select doc_id, start, is_hex, i from windows
  where list_aggregate(string_split(hit[i + 1:i + {WINDOW}], ''), 'entropy') >= case when is_hex then {THRESHOLD["entropy_hex"]} else {THRESHOLD["entropy_base64"]} end - 1e-9),
added as (select doc_id, start + min(i) as start, case when is_hex then 3 else 4 end as ord, case when is_hex then 'entropy_hex' else 'entropy_base64' end as kind, start + max(i) + {WINDOW} as stop from good group by doc_id, good.start, is_hex),
every as (select doc_id, start, ord, kind, stop from base union all select doc_id, start, ord, kind, stop from added),
joined as (
  select doc_id, count(*) filter (ord = 0) as n_assign, count(*) filter (ord = 1) as n_access, count(*) filter (ord = 2) as n_hex,
    coalesce(string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, ord) filter (ord < 3), '') as base_spans,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, ord, stop) as spans
  from every group by doc_id)
select key as doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from bodies left join joined using (doc_id)
"""

OP3 = """
with rows as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) + 1 as n from documents),
totals as (select source, sum(n)::double as tokens, sum(sum(n)) over ()::double as every from rows group by source),
tried as (
  select k from totals, range(0, 4097) as grid(k) group by k
  having max(pow(tokens / every, k / 4096.0::double) / tokens) * max(tokens / pow(tokens / every, k / 4096.0::double)) <= 2 + 1e-9),
chosen as (select coalesce(min(k), 4096) / 4096.0::double as alpha from tried),
powers as (select source, tokens, pow(tokens / every, alpha) as p from totals, chosen),
planned as (select source, tokens, p / sum(p) over () as weight, round(p * max(tokens / p) over () / tokens, 9) as repeats from powers),
sources as (
  select source, weight, cast(floor(repeats) as integer) as epochs, floor((repeats - floor(repeats)) * tokens + 1e-6) as rest, cast(ceil(tokens / 65536) as integer) as blocks from planned),
drawn as (
  select doc_id, source, n, epoch, weight, epochs, rest, blocks, cast('0x' || substr(md5('17:' || epoch || ':' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) as place
  from (select doc_id, r.source, n, weight, epochs, rest, blocks, unnest(range(0, epochs + 1)) as epoch from rows r join sources s on r.source is not distinct from s.source)),
summed as (select *, sum(n) over (partition by source, epoch order by place range between unbounded preceding and current row) as upto from drawn),
taken as (
  select *, least(cast(floor(place::double * blocks / 281474976710656.0::double) as integer), blocks - 1) as block from summed where epoch < epochs or upto <= rest)
select doc_id, source, n as n_tokens, cast(epoch as integer) as epoch, block,
  cast(row_number() over (partition by source, epoch, block order by place, doc_id, n) - 1 as integer) as rank, round(weight, 9) as weight
from taken
"""

OP6 = f"""
with recursive words as (select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then []
    when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end)) as s from words),
classes as (select min(doc_id) as rep, sha256(array_to_string(s, chr(10))) as h, any_value(s) as s from sets where len(s) > 0 group by h),
shingles as (select rep, len(s) as n, unnest(s) as x from classes),
pairs as (
  select a.rep as u, b.rep as v, a.n as nu, b.n as nv, count(*) as n_common from shingles a join shingles b on a.x = b.x and a.rep < b.rep
  where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
linked as (select u, v from pairs where 100 * n_common >= 85 * (nu + nv - n_common)),
links(a, b) as (select u, v from linked union all select v, u from linked),
{REACH}
select doc_id, len(sets.s)::bigint as n_shingles, coalesce(low, rep, doc_id)::bigint as component_id
from sets left join classes on len(sets.s) > 0 and classes.h = sha256(array_to_string(sets.s, chr(10))) left join reach on node = rep
"""

FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

OP7 = f"""
with vectors as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings where {FINITE}),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from vectors q join vectors c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 20
"""

OP10 = f"""
with recursive vectors as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and {FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links(a, b) as (
  select x.vec_id, y.vec_id from vectors x join vectors y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where list_cosine_similarity(x.v, y.v) >= 0.93),
degrees as (select a, count(*) as n from links group by a),
{REACH}
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(low, vec_id)::bigint as component_id, coalesce(low, vec_id) = vec_id as kept
from embeddings left join degrees on a = vec_id left join reach on node = vec_id
"""

def _round(n: int, rounds: int) -> str:
    """Assignment of every vector to the centroids of round n and, but for the last round, the next centroids."""
    near = f"""near{n} as (
  select vec, vec_id, v, arg_min(k, (d, k)) as k, min(d) as d
  from (select vec, vec_id, v, k, list_inner_product(list_transform(range(1, 65), lambda i: v[i] - c[i]), list_transform(range(1, 65), lambda i: v[i] - c[i])) as d from vectors cross join means{n}) group by vec, vec_id, v)"""
    if n == rounds:
        return near
    return near + f""",
means{n + 1} as (
  select k, coalesce(s, c) as c from means{n} left join (
    select k, list_transform(range(1, 65), lambda i: floor(list_sum(list_transform(vs, lambda v: v[i])) / len(vs))) as s from (select k, list(v) as vs from near{n} group by k)) using (k))"""


OP13 = f"""
with vectors as (
  select row_number() over () as vec, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings where len(embedding) = 64 and {FINITE}),
means0 as (select row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as k, v as c from vectors qualify k < 40),
{", ".join(_round(n, 5) for n in range(6))},
whole as (select sum(d) as d from near5), sums as (select k, sum(d) as d from near5 group by k)
select vec_id, n.k::integer as cluster, n.d::bigint as distance, s.d::bigint as cluster_inertia, w.d::bigint as inertia,
  sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from near5 n join means5 m using (k) join sums s using (k) cross join whole w
"""

SQL = {"op2_secret_scan": OP2, "op3_source_mixing": OP3, "op6_ngram_jaccard": OP6, "op7_exact_topk": OP7, "op10_embedding_dedup": OP10, "op13_centroid_clusters": OP13}
