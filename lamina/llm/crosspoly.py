"""Near-duplicate embeddings by cross-polytope hashing.

Rows of one label with the same vector are one class with a weight, so copies cost nothing
further. Vectors are scaled to length one in double precision and padded to a power of two. A
hash is three rounds of random signs and a fast Hadamard transform; its value is the coordinate
of largest size with its sign. A table joins `hashes` of them to one bucket; besides its
own bucket a vector enters `probes` - 1 more, with second-best coordinates. Vectors of one
label that share a bucket are candidates, and every candidate pair is verified by its
cosine in double precision, so a link is never wrong and is missed only if the two vectors
share no bucket of any table (recall is measured in the tests for 2 and 3 hashes).

Buckets are found by class numbers alone; vectors travel once, to buckets of two or more. A
bucket of more than `block` classes is dealt into blocks, and pairs of blocks are jobs of
their own, so no task holds a bucket whole. Jobs return counts and a spanning forest of
the links they found, never the pairs. A pair that shares several buckets is counted in
the first of them only.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing; so do vectors of different lengths. Equal vectors of a
label link. Rows with a null key are returned with a null component. Repeated keys are
rows of their own that don't link with each other, but their counts are added up under
the key. Ties can't arise; an empty table gives no rows. Of the input only the key, the vector
and the label are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, components, cut, few, slim, tidy
from .topk import valid_vectors

by_value(__name__)


#: Stands for the key of a class whose keys are not repeated.
NONE = -(1 << 63)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) bucket numbers of unit vectors."""
    n, d = x.shape
    size = 1 << max(0, int(d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        first, second, gap = [], [], []
        for k in range(hashes):
            signs = np.random.Generator(np.random.PCG64([seed, t, k])).choice([-1.0, 1.0], (3, size))
            y = x
            for s in signs:
                y = hadamard(y * s)
            two = np.argpartition(-np.abs(y), min(1, size - 1), axis=1)[:, :2]
            z = np.take_along_axis(y, two, 1)
            swap = np.abs(z[:, :1]) < np.abs(z[:, -1:])
            two, z = np.where(swap, two[:, ::-1], two), np.where(swap, z[:, ::-1], z)
            code = two * 2 + (z < 0)
            first.append(code[:, 0])
            second.append(code[:, -1])
            gap.append(np.abs(z[:, 0]) - np.abs(z[:, -1]))
        first, second, gap = np.stack(first, 1), np.stack(second, 1), np.stack(gap, 1)
        base = 2 * size
        weights = np.array([base**k for k in range(hashes)], np.int64)
        own = first @ weights
        # The next buckets: one coordinate replaced, the closest race first; then two, and so on.
        order = np.argsort(gap, axis=1, kind="stable")
        out[:, t, 0] = own
        for p in range(1, probes):
            code = first.copy()
            for j in range(hashes):
                if p >> j & 1:
                    at = order[:, j]
                    code[np.arange(n), at] = second[np.arange(n), at]
            out[:, t, p] = code @ weights
    return out


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors, from their bytes as float or double, in double precision and of length one."""
    raw = b"".join(blobs)
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(blobs) else np.float64).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _valid(wide: bool):
    """(id, label, dim, v) of the rows that can link; v are the components as they came."""

    def run(batches):
        for batch in few(batches, 4096):
            ok, n, flat, offsets = valid_vectors(batch, "vector")
            ok &= np.asarray(batch.column("label").is_valid()) & np.asarray(batch.column("id").is_valid())
            with np.errstate(over="ignore"):
                raw = flat if wide else flat.astype(np.float32)
            at = [i for i in np.flatnonzero(ok) if flat[offsets[i] : offsets[i + 1]].any()]
            if at:
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), pa.array(n[at].astype(np.int32)), pa.array([raw[offsets[i] : offsets[i + 1]].tobytes() for i in at], pa.binary())], names=["id", "label", "dim", "v"])

    return run


def _hash(tables: int, hashes: int, probes: int, seed: int):
    def run(batches):
        for batch in few(batches, 4096):
            dims, blobs = np.asarray(batch.column("dim")), batch.column("v").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes = buckets(unit([blobs[i] for i in at], int(dim)), tables, hashes, probes, seed)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([r.astype(">i8").tobytes() for r in codes], pa.binary())], names=[*batch.schema.names, "codes"])

    return run


def _job(cosine: float, tables: int, probes: int):
    """(cid, n, low) from rows sorted by job and side: what each class links with, and the least class it hangs on."""

    def linked(p, q, t, x, codes):
        """The pairs that link, and whether their job's bucket is the first that they share."""
        hit = np.concatenate([(x[p[s : s + 8192]] * x[q[s : s + 8192]]).sum(1) >= cosine for s in range(0, len(p), 8192)] or [np.zeros(0, bool)])
        hit &= (t["own"][p] != t["own"][q]) | (t["own"][p] == NONE)
        p, q = p[hit], q[hit]
        fresh = np.ones(len(p), bool)
        for s in range(0, len(p), 8192):
            u, v = p[s : s + 8192], q[s : s + 8192]
            same = codes[u][:, :, :, None] == codes[v][:, :, None, :]
            table, bucket = t["table"][u], t["bucket"][u]
            same &= np.arange(tables)[None, :, None, None] <= table[:, None, None, None]
            same &= (np.arange(tables)[None, :, None, None] < table[:, None, None, None]) | (codes[u][:, :, :, None] < bucket[:, None, None, None])
            fresh[s : s + 8192] = ~same.any((1, 2, 3))
        return p, q, fresh

    def pairs(t):
        """Index pairs of the jobs in t, some at a time."""
        new = np.any([t[c][1:] != t[c][:-1] for c in ("job", "table", "bucket", "i", "j")], axis=0)
        edge = np.flatnonzero(np.concatenate([[True], new]))
        size = np.diff(np.append(edge, len(t["job"])))
        p, q, held = [], [], 0
        for s, m in zip(edge, size, strict=True):
            if t["i"][s] == t["j"][s]:
                a, b = np.triu_indices(m, 1)
            else:
                first = int((t["side"][s : s + m] == t["i"][s]).sum())
                a, b = (v.ravel() for v in np.meshgrid(np.arange(first), np.arange(first, m), indexing="ij"))
            p.append(a + s)
            q.append(b + s)
            held += len(a)
            if held > 1 << 18:
                yield np.concatenate(p), np.concatenate(q)
                p, q, held = [], [], 0
        if held:
            yield np.concatenate(p), np.concatenate(q)

    def work(t):
        codes = np.frombuffer(b"".join(t["codes"]), ">i8").astype(np.int64).reshape(-1, tables, probes)
        out = []
        for dim in np.unique(t["dim"]):
            at = np.flatnonzero(t["dim"] == dim)
            part = {c: v[at] for c, v in t.items()}
            x, own_codes = unit(list(part["v"]), int(dim)), codes[at]
            for p, q in pairs(part):
                p, q, fresh = linked(p, q, part, x, own_codes)
                if len(p):
                    out.append((part["cid"][p], part["cid"][q], np.where(fresh, part["w"][q], 0), np.where(fresh, part["w"][p], 0)))
        if not out:
            return None
        p, q, wp, wq = (np.concatenate(v) for v in zip(*out, strict=True))
        ids, k = np.unique(np.concatenate([p, q]), return_inverse=True)
        counts = np.bincount(k, np.concatenate([wp, wq]), len(ids)).astype(np.int64)
        p, q, label = k[: len(p)], k[len(p) :], np.arange(len(ids))
        while True:  # a spanning forest: every node hangs on the least label of its links until nothing changes
            new = label.copy()
            np.minimum.at(new, p, label[q])
            np.minimum.at(new, q, label[p])
            new = new[new]
            if (new == label).all():
                return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(ids[label])], names=["cid", "n", "low"])
            label = new

    def run(batches):
        names, held = ["cid", "w", "own", "dim", "table", "bucket", "i", "j", "side", "job"], None
        for batch in few(batches, 2048):
            t = {c: np.asarray(batch.column(c)) for c in names} | {c: np.array(batch.column(c).to_pylist(), object) for c in ("codes", "v")}
            t = t if held is None else {c: np.concatenate([held[c], v]) for c, v in t.items()}
            last = int(np.searchsorted(t["job"], t["job"][-1], "left"))
            held = {c: v[last:] for c, v in t.items()}
            if last and (out := work({c: v[:last] for c, v in t.items()})) is not None:
                yield out
        if held is not None and (out := work(held)) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, tables: int | None = None, hashes: int | None = None, probes: int = 2, block: int = 1024, seed: int = 31, broadcast_rows: int = 100_000) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; see above.

    hashes, unless given, is 2 and grows with the logarithm of the largest label, so that buckets stay small; tables
    grow with it, so that recall stays.
    """
    plain = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kind, wide = plain.schema["label"].dataType.simpleString(), plain.schema["vector"].dataType.elementType.simpleString() != "float"
    light = lambda df: F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df
    rows = cut(plain.mapInArrow(tidy(_valid(wide)), f"id long, label {kind}, dim int, v binary"))
    if hashes is None:
        hashes, most = 2, rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        while most > 1024 * 64**hashes:
            hashes += 1
    tables, probes = tables or 3 * 2**hashes, min(probes, 2**hashes)
    # A repeated key is `own` to its rows: they are in no class with other keys.
    repeated = slim(rows.groupBy("id").count().where("count > 1").select("id", F.col("id").alias("own")))
    rows = rows.join(light(repeated), "id", "left").withColumn("own", F.coalesce("own", F.lit(NONE)))
    same = ["label", "dim", "v", "own"]
    classes = rows.groupBy(*same).agg(F.count("*").alias("w"), F.min("id").alias("rep")).withColumn("cid", F.monotonically_increasing_id())
    hashed = cut(classes.mapInArrow(tidy(_hash(tables, hashes, probes, seed)), f"label {kind}, dim int, v binary, own long, w long, rep long, cid long, codes binary"))
    # (table, bucket) of every probe, from the packed codes, in SQL: 8 bytes each, most significant first.
    # A class enters a bucket once, whichever of its probes lead there.
    place = f"named_struct('table', cast(floor(slot / {probes}) as int), 'bucket', cast(conv(hex(substring(codes, slot * 8 + 1, 8)), 16, 10) as bigint))"
    places = F.explode(F.expr(f"array_distinct(transform(sequence(0, {tables * probes - 1}), slot -> {place}))"))
    keys = ["label", "dim", "table", "bucket"]
    slots = cut(hashed.select("cid", "label", "dim", places.alias("place")).select("cid", "label", "dim", "place.table", "place.bucket"))
    sizes = slots.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    placed = slots.join(sizes, keys).withColumn("side", F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("blocks")).cast("int"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    jobs = other.select(*keys, F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "cid")
    jobs = jobs.withColumn("job", F.xxhash64(*keys, "i", "j")).drop("label", "dim").join(hashed.select("cid", "dim", "w", "own", "codes", "v"), "cid")
    order = ["job", "table", "bucket", "dim", "i", "j", "side", "cid"]
    dealt = jobs.repartition("job").sortWithinPartitions(*order).select("cid", "w", "own", "dim", "table", "bucket", "i", "j", "side", "job", "codes", "v")
    found = slim(dealt.mapInArrow(tidy(_job(cosine, tables, probes)), "cid long, n long, low long").groupBy("cid", "low").agg(F.sum("n").alias("n")))
    # Rows of a repeated key are one node of the links.
    kin = hashed.where(F.col("own") != NONE).select("own", "cid").join(hashed.where(F.col("own") != NONE).groupBy("own").agg(F.min("cid").alias("low")), "own").select("cid", "low")
    reach = components(found.select("cid", "low").union(kin), "cid", "low").select(F.col("node").alias("cid"), F.col("component").alias("group"))
    known = hashed.select("cid", "own", "w", "rep").join(reach, "cid", "left").withColumn("group", F.coalesce("group", "cid"))
    least = known.groupBy("group").agg(F.min("rep").alias("component"))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    known = slim(known.join(least, "group").join(counts, "cid", "left").select("cid", "component", (F.coalesce("n", F.lit(0)) + F.when(F.col("own") == NONE, F.col("w") - 1).otherwise(0)).alias("n")))
    per_row = rows.select("id", *same).join(hashed.select(*same, "cid"), same).select("id", "cid").join(light(known), "cid")
    named = per_row.groupBy("id").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    out = vectors.select(F.col(key).alias("key")).join(named, F.col("key") == F.col("id"), "left")
    component = F.coalesce("component", F.col("key").cast("long"))
    return out.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
