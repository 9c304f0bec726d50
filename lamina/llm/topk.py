"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors become integers floor(scale * x). Candidates are dealt into blocks by a hash of their id.
A block is sorted once per dimension; then the queries stream past it in Arrow batches. For a
query the lists are read, each from the end that its sign favours, in rounds of doubling
depth; what is met for the first time is scored, and reading stops when the sum of what the lists
can still give is below the kth score. Ties go to the smaller id, so it goes on while the bound
equals the kth score.

Two passes share the bound: a query first meets the block of its own row; the kth score found
there goes with it to all other blocks, so a block whose extremes cannot beat it is not read at
all, and reading of the others stops sooner. Blocks return at most k rows a query; a window takes the
best k of all. A task holds one block of row_block rows and one batch of queries; queries are
copied once for each block, candidates twice.

Scores are exact integers: below 2^53 in double precision, below 2^62 in 64-bit integers. Pairs with a
component so large that a product could pass that are scored in unbounded integers; components beyond
2^62 count as 2^62, scores beyond 64 bits as the largest or smallest long. Vectors that are null or hold null or
non-finite components take no part; vectors of different lengths are not compared; empty
ones take no part. Repeated ids are rows of their own, except that a query never meets a
row of its own id, and a repeated query is asked once for each of its rows; of equal (score, id) any comes
first. No vectors, or no queries, give no rows. Only the key, the vector and what is_query
reads are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, cut, few, tidy

by_value(__name__)


#: The largest component, as a double.
HUGE = float(1 << 62)


def valid_vectors(batch, column: str):
    """(mask, lengths, flat values as double) of the vectors that are not null or empty and hold finite components only."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets)
    values = lists.values
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    n = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (n > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & np.asarray(lists.is_valid())
    return ok, n, flat, offsets


def _quantise(scale: int):
    def run(batches):
        for batch in few(batches, 4096):
            ok, n, flat, offsets = valid_vectors(batch, "vector")
            at = np.flatnonzero(ok)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(flat * scale), nan=0.0, posinf=HUGE, neginf=-HUGE), -HUGE, HUGE).astype(np.int64)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("q"), pa.array(n[at].astype(np.int32)), pa.array([whole[offsets[i] : offsets[i + 1]].tobytes() for i in at], pa.binary())], names=["id", "q", "dim", "v"])

    return run


def threshold(query: np.ndarray, own: int, block, k: int, least: int | None, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of a block for one query, without those below `least`; block is (ids, c, order, ranked):
    order[d] are positions by ascending c[:, d], ranked[d] their values."""
    ids, c, order, ranked = block
    m = len(ids)
    dims = np.flatnonzero(query)
    up, down = dims[query[dims] > 0], dims[query[dims] < 0]
    signed = np.concatenate([query[up], query[down]])
    seen = ids == own
    best_i, best_s = np.zeros(0, np.int64), np.zeros(0, c.dtype)
    depth, step = 0, max(1, start)
    while depth < m:
        # What the lists can still give; nothing below the kth score or `least` is wanted.
        limit = (np.concatenate([ranked[up, m - depth - 1], ranked[down, depth]]) * signed).sum()
        if least is not None and limit < least or len(best_i) >= k and limit < best_s.min():
            break
        new = min(m, depth + step) if len(dims) else m
        met = np.zeros(m, bool)
        if len(dims):
            met[order[up, m - new : m - depth].ravel()] = True
            met[order[down, depth:new].ravel()] = True
        else:
            met[:] = True
        fresh = np.flatnonzero(met & ~seen)
        depth, step = new, step * 4
        seen[fresh] = True
        scores = c[fresh] @ query
        if least is not None:
            fresh, scores = fresh[scores >= least], scores[scores >= least]
        best_i, best_s = np.concatenate([best_i, fresh]), np.concatenate([best_s, scores])
        if len(best_i) > k:
            top = np.lexsort((ids[best_i], -best_s))[:k]
            best_i, best_s = best_i[top], best_s[top]
    top = np.lexsort((ids[best_i], -best_s))[:k]
    return ids[best_i[top]], best_s[top].astype(np.int64)


def _exactly(query, own, ids, c, k):
    """As threshold(), over few rows in unbounded integers."""
    scores = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(query, x, strict=True)))) for x in c]
    best = sorted((-s, int(i)) for s, i in zip(scores, ids, strict=True) if i != own)[:k]
    return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


def _blocks(k: int, start: int):
    """(query_id, id, score) from rows sorted by block and kind: the rows of a block (kind 0), then the queries that meet it."""

    def sorted_block(rows):
        """By length: the rows of ordinary size, ready to be searched, and the few others."""
        out = {}
        for dim in {r[1] for r in rows}:
            ids = np.array([r[0] for r in rows if r[1] == dim], np.int64)
            c = np.frombuffer(b"".join(r[2] for r in rows if r[1] == dim), np.int64).reshape(len(ids), dim)
            peak, most = np.abs(c).max(1), limits(dim)
            small = c[peak <= most[1]]
            small = small.astype(np.float64) if len(small) and np.abs(small).max() <= most[0] else small
            order = np.ascontiguousarray(np.argsort(small, axis=0, kind="stable").T)
            block = ids[peak <= most[1]], small, order, np.take_along_axis(np.ascontiguousarray(small.T), order, 1)
            out[dim] = block, (ids[peak > most[1]], c[peak > most[1]]), (ids, c)
        return out

    def limits(dim):
        """Components up to these give products whose sums stay below 2^53 and 2^62."""
        return (1 << (53 - dim.bit_length()) // 2), (1 << (62 - dim.bit_length()) // 2)

    def best(q, own, found, least):
        block, odd, every = found
        most = limits(len(q))
        top = np.abs(q).max()
        if top > most[1]:
            return _exactly(q, own, *every, k)
        if block[1].dtype == np.float64 and top <= most[0]:
            got = threshold(q.astype(np.float64), own, block, k, least, start)
        else:
            got = threshold(q, own, (block[0], block[1].astype(np.int64), block[2], block[3].astype(np.int64)), k, least, start)
        if not len(odd[0]):
            return got
        more = _exactly(q, own, *odd, k)
        return np.concatenate([got[0], more[0]]), np.concatenate([got[1], more[1]])

    def run(batches):
        at, held, block = None, [], None
        for batch in few(batches, 1024):
            out = []
            for b, kind, i, dim, v, least in zip(*[batch.column(c).to_pylist() for c in ("block", "kind", "id", "dim", "v", "least")], strict=True):
                if b != at:
                    at, held, block = b, [], None
                if kind == 0:
                    held.append((i, dim, v))
                    continue
                if block is None:
                    block, held = sorted_block(held), []
                if dim in block:
                    ids, scores = best(np.frombuffer(v, np.int64), i, block[dim], least)
                    out.append((i, ids, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _, _ in out], np.int64), [len(x) for _, x, _ in out])), pa.array(np.concatenate([x for _, x, _ in out])), pa.array(np.concatenate([s for *_, s in out]))], names=["query_id", "id", "score"])

    return run


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64, row_block: int = 8192, start: int = 256) -> DataFrame:
    """(query_id, rank from 1, <key>, score): the k best rows of every row for which the Column is_query holds.

    Keys are of an integer type and not null (a row with a null key takes no part).
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector).alias("vector")).where("id is not null")
    whole = cut(rows.mapInArrow(tidy(_quantise(scale)), "id long, q boolean, dim int, v binary"))
    blocks = max(1, -(-whole.count() // row_block))
    block = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(blocks)).cast("int").alias("block")
    base = whole.select(block, F.lit(0).alias("kind"), "id", "dim", "v", F.lit(None).cast("long").alias("least"))
    asked = whole.where("q").select("id", "dim", "v")

    def meet(queries):
        both = base.union(queries.select("block", F.lit(1).alias("kind"), "id", "dim", "v", "least"))
        return both.repartition(max(1, min(blocks, 1 << 20)), "block").sortWithinPartitions("block", "kind").mapInArrow(tidy(_blocks(k, start)), "query_id long, id long, score long")

    own = cut(meet(asked.withColumn("least", F.lit(None).cast("long")).withColumn("block", block)))
    bound = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    other = asked.withColumn("own", block).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> own")
    other = other.join(bound, other.id == bound.query_id, "left")
    found = own.union(meet(other))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
