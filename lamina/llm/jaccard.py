"""N-gram Jaccard self-join over whole texts, exact, by a count-vector R-tree.

A text's set is its distinct shingles of `words` words. Shingles are hashed into 1024 groups
and a set's counts by group are a point; the overlap of two sets is at most the sum of the
smaller coordinates. An R-tree over points keeps in every node the largest coordinates (summed
to 64) and the span of sizes of what lies below, so one sum bounds all pairs of two nodes.
Trees are joined from their tops down; then the 64 sums and last all 1024 coordinates bound
single pairs, and pairs that survive are verified on the shingles themselves.

How the points are dealt over the cluster, without losing a pair:
1. Equal sets become one class, told by a digest of 128 bits. The same pass over the texts
   counts, over all rows, how many sets use each of 2^20 groups of shingles.
2. All sets order their shingles by that count, then by hash. Two sets that link share a
   shingle among the first n - ceil(t*n) + 1 of each, so every class is in the cells of these
   shingles only. Cells of one class are dropped, of cells with the same classes one is kept.
3. Every set of a cell is bounded, then verified, against the cell's most central one. The
   links so found make components; a cell whose sets are all in one has no more to find.
4. The sets of the other cells are sorted by cell, component and size over the cluster and packed
   into blocks of `capacity` sets: the subtrees that are dealt out. A cell may have any number
   of them, on any number of tasks. The blocks' tops are joined first; two blocks that pass, or one
   with itself, are one unit of work, so memory follows the capacity and not the cell. Pairs in one
   component are left out: first the closest pair of every set is verified, and, when these are
   joined as well, all that are left. So groups of thousands of near copies cost stars and few
   pairs more, and no link between different texts is missed: every linked pair ends in one component.

Null and empty texts and those without words have an empty set, link with nothing and are
components of their own. Texts shorter than `words` words are one shingle. Repeated rows
are equal sets. Shingles are 64-bit digests. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, components, cut, few, slim, tidy, unused

by_value(__name__)

GROUPS = 1024
COARSE = 64
DF_BITS = 20
SLICE = 4096
FANOUT = 8
PAIRS = 4096


class Shingler:
    """Sorted distinct 64-bit shingles of a text; A-Z in lower case, words between ASCII white space."""

    def __init__(self, words: int):
        g = np.random.Generator(np.random.PCG64(20240229))
        self.words = words
        self.code = g.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        lower = np.arange(256)
        lower[65:91] += 32
        self.code = self.code[lower]
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.mult = g.integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15 | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            for name, r in (("up", self.base), ("down", self.inverse)):
                out, done, step = np.ones(n, np.uint64), 1, r
                with np.errstate(over="ignore"):
                    while done < n:
                        k = min(done, n - done)
                        out[done : done + k] = out[:k] * np.uint64(step)
                        done, step = done + k, step * step % (1 << 64)
                setattr(self, name, out)

    @staticmethod
    def mix(x):
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        white = self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        self._powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.code[raw] * self.up[: len(raw)], dtype=np.uint64)])
            return self.mix((sums[last] - sums[first]) * self.down[first])

    def word_hashes(self, text: str, piece: int = 1 << 18) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) <= piece:
            return self._hashes(raw)
        out, at = [], 0
        while at < len(raw):  # pieces end at white space, so memory does not follow the text
            end = min(len(raw), at + piece)
            while end < len(raw) and not self.space[raw[end]]:
                end += 1
            out.append(self._hashes(raw[at:end]))
            at = end
        return np.concatenate(out)

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.word_hashes(text) if text else np.zeros(0, np.uint64)
        n, k = len(h), self.words
        if not n:
            return h
        with np.errstate(over="ignore"):
            if n < k:
                return self.mix(np.array([np.uint64(n) + (h * self.mult[:n]).sum(dtype=np.uint64)]))
            s = h[: n - k + 1] * self.mult[0]
            for i in range(1, k):
                s = s + h[i : n - k + 1 + i] * self.mult[i]
        return np.unique(self.mix(s))


def ref_of(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set, as two numbers of 64 bits."""
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def point(s: np.ndarray) -> bytes:
    c = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=GROUPS)
    return zstandard.compress(c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes(), 1)


def points(blobs: list[bytes]) -> np.ndarray:
    raw = [zstandard.decompress(b) for b in blobs]
    if all(len(b) == GROUPS for b in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(b, np.uint8 if len(b) == GROUPS else np.uint32).astype(np.uint32) for b in raw])


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many shingles are common: the sums of the smaller coordinates."""
    return np.minimum(a, b).sum(1, dtype=np.int64)


def need(num: int, den: int, a, b):
    """The least overlap of linked sets of these sizes."""
    return -(-num * (a + b) // (num + den))


def df_group(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)


def _digests(words: int, key_type):
    """A row for every text (slice -1), and at the end this task's counts by group in slices."""

    def run(batches):
        shingles, df = Shingler(words), np.zeros(1 << DF_BITS, np.int64)
        names = ["key", "n", "ra", "rb", "slice", "counts"]
        for batch in few(batches):
            sizes, refs = [], []
            for x in batch.column(1).to_pylist():
                s = shingles(x)
                sizes.append(len(s))
                refs.append(ref_of(s) if len(s) else (None, None))
                np.add.at(df, df_group(s), 1)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array([a for a, _ in refs], pa.int64()), pa.array([b for _, b in refs], pa.int64()), pa.array([-1] * k, pa.int32()), pa.nulls(k, pa.binary()),
            ], names=names)
        at = [i for i in range(0, len(df), SLICE) if df[i : i + SLICE].any()]
        if at:
            blobs = [zstandard.compress(df[i : i + SLICE].tobytes(), 3) for i in at]
            k = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, key_type), *[pa.nulls(k, pa.int64())] * 3, pa.array([i // SLICE for i in at], pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return run


def _sum_slices(t: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for b in t.column("counts"):
        total += np.frombuffer(zstandard.decompress(b.as_py()), np.int64)
    return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})


def prefix(num: int, den: int, n):
    """So many shingles of a set of n, in one order of all shingles, hold one of every set that links with it."""
    return n - -(-num * n // den) + 1


def _prefixes(words: int, num: int, den: int, df, hot: int):
    """(tok, salt, ra, rb, n): the first shingles of every set with its digest and size. A task emits equal sets once.

    A shingle whose group counts more than `hot` sets is dealt over several salts, so that one salt has about `hot`
    rows; salt is -1 for all others, of which no more than `hot` rows exist."""

    def run(batches):
        shingles, seen, table = Shingler(words), set(), df.value
        for batch in few(batches):
            toks, refs, sizes, ns, counts = [], [], [], [], []
            for x in batch.column(0).to_pylist():
                s = shingles(x)
                if not len(s) or (r := ref_of(s)) in seen:
                    continue
                seen.add(r)
                p, c = prefix(num, den, len(s)), table[df_group(s)]
                first = np.lexsort((s, c))[:p]
                toks.append(s[first])
                counts.append(c[first])
                refs.append(r)
                sizes.append(p)
                ns.append(len(s))
            if toks:
                both, c = np.repeat(np.array(refs, np.int64), sizes, axis=0), np.concatenate(counts).astype(np.int64)
                salt = np.where(c > hot, both[:, 0].view(np.uint64) % (c // hot + 1).astype(np.uint64), 0).astype(np.int64) - (c <= hot)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(toks).view(np.int64)), pa.array(salt), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(np.repeat(np.array(ns, np.int32), sizes)),
                ], names=["tok", "salt", "ra", "rb", "n"])

    return run


def _zip_text(words: int):
    """The text of each class once per task, told by its digest: rows of another text under the same key are not taken."""

    def run(batches):
        shingles, seen = Shingler(words), set()
        for batch in few(batches):
            got = []
            for ref, ra, rb, x in zip(*[batch.column(c).to_pylist() for c in ("ref", "ra", "rb", "text")], strict=True):
                if ref not in seen and len(s := shingles(x)) and ref_of(s) == (ra, rb):
                    seen.add(ref)
                    got.append((ref, len(s), point(s), zstandard.compress(x.encode(), 3)))
            if got:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*got, strict=True), kinds, strict=True)], names=["ref", "n", "point", "text"])

    return run


class CountTree:
    """An R-tree over count vectors, bulk-loaded: a set of points is halved at the median of the summed coordinate that
    varies most until FANOUT of them make a leaf; FANOUT neighbouring nodes make one of the next level. levels[0] are the
    points, the last level is the top. A node has its largest coordinates, its least and its largest set, and its label
    where all its sets have one (else -1)."""

    def __init__(self, refs, sizes, labels, counts):
        sums = counts.reshape(len(counts), COARSE, -1).sum(2, dtype=np.int32)
        order = np.concatenate(list(self._halves(sums, np.arange(len(sums)))))
        self.refs, self.counts = refs[order], counts[order]
        self.levels = [(sums[order], sizes[order], sizes[order], labels[order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high, label = self.levels[-1]
            starts = np.arange(0, len(top), FANOUT)
            first, last = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            self.levels.append((np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.where(first == last, first, -1)))

    @classmethod
    def _halves(cls, sums, at):
        if len(at) <= FANOUT:
            yield at
            return
        by = sums[at].var(0).argmax()
        at = at[np.argsort(sums[at, by], kind="stable")]
        leaves = -(-len(at) // FANOUT)
        cut_at = leaves // 2 * FANOUT
        yield from cls._halves(sums, at[:cut_at])
        yield from cls._halves(sums, at[cut_at:])


def tree_join(a: CountTree, b: CountTree, num: int, den: int):
    """(i, j, bound) of all points of a and b with different labels whose bound admits a link; of each pair once where
    b is a. Pairs of nodes are taken from the top of both trees down; those that cannot hold such a pair are left."""
    depth = max(len(a.levels), len(b.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    at = np.stack(np.meshgrid(np.arange(len(a.levels[-1][0])), np.arange(len(b.levels[-1][0])), indexing="ij"), -1).reshape(-1, 2)
    stack = [(depth - 1, at)]
    while stack:
        k, at = stack.pop()
        if len(at) > PAIRS:  # what is open stays small: depth first, PAIRS at a time
            stack.extend((k, at[i : i + PAIRS]) for i in range(0, len(at), PAIRS))
            continue
        i, j = at[:, 0], at[:, 1]
        (ta, la, ha, ga), (tb, lb, hb, gb) = level(a, k), level(b, k)
        good = (den * hb[j] >= num * la[i]) & (den * ha[i] >= num * lb[j]) & ((ga[i] != gb[j]) | (ga[i] == -1))
        if a is b:
            good &= i < j if k == 0 else i <= j
        i, j = i[good], j[good]
        x, y = la[i], lb[j]
        good = overlap(ta[i], tb[j]) >= need(num, den, np.maximum(x, -(-num * y // den)), np.maximum(y, -(-num * x // den)))
        i, j = i[good], j[good]
        if not len(i):
            continue
        if k == 0:
            for s in range(0, len(i), PAIRS // 8):
                u, v = i[s : s + PAIRS // 8], j[s : s + PAIRS // 8]
                bound = overlap(a.counts[u], b.counts[v])
                good = bound >= need(num, den, a.levels[0][1][u], b.levels[0][1][v])
                yield u[good], v[good], bound[good]
            continue
        below = []
        for t, x in ((a, i), (b, j)):  # a lower tree waits at its top
            n = len(level(t, k - 1)[0])
            below.append(np.where((c := x[:, None] * FANOUT + np.arange(FANOUT)) < n, c, -1) if k < len(t.levels) else x[:, None])
        at = np.stack(np.broadcast_arrays(below[0][:, :, None], below[1][:, None, :]), -1).reshape(-1, 2)
        stack.append((k - 1, at[(at >= 0).all(1)]))


def _pack(capacity: int):
    """Rows sorted by cell, label, size -> blocks of one cell, of at most `capacity` sets: a subtree each, with its top.

    A row (cell, block, low, high, label, top, data): label is -1 where there are several."""

    def run(batches):
        from pyspark import TaskContext

        serial, names = TaskContext.get().partitionId() << 32, ["cell", "block", "low", "high", "label", "top", "data"]

        def block(cell, held):
            nonlocal serial
            refs, sizes, labels, blobs = ([r[k] for r in held] for k in range(4))
            c = points(blobs)
            top = c.reshape(len(c), COARSE, -1).sum(2, dtype=np.int32).max(0)
            head = np.array([len(refs), c.itemsize], np.int64).tobytes()
            data = head + np.array(refs, np.int64).tobytes() + np.array(sizes, np.int64).tobytes() + np.array(labels, np.int64).tobytes() + c.tobytes()
            serial += 1
            return cell, serial, min(sizes), max(sizes), labels[0] if len(set(labels)) == 1 else -1, top.tolist(), zstandard.compress(data, 1)

        def table(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        cell, held, out = None, [], []
        for batch in few(batches):
            for c, *r in zip(*[batch.column(x).to_pylist() for x in ("cell", "ref", "n", "label", "point")], strict=True):
                if held and (c != cell or len(held) == capacity):
                    out.append(block(cell, held))
                    held = []
                cell = c
                held.append(r)
            if out:
                yield table(out)
                out = []
        if held:
            yield table([block(cell, held)])

    return run


def _tree(data: bytes) -> CountTree:
    raw = zstandard.decompress(data)
    m, wide = np.frombuffer(raw, np.int64, 2)
    refs, sizes, labels = np.frombuffer(raw, np.int64, 3 * m, 16).reshape(3, m)
    return CountTree(refs, sizes, labels, np.frombuffer(raw, np.uint8 if wide == 1 else np.uint32, m * GROUPS, 16 + 24 * m).reshape(m, GROUPS))


def _searched(num: int, den: int, only_best: bool):
    """(a, b, close) of the pairs of two blocks, or of one with itself, that may link; if only_best, the closest one of every set."""

    def run(batches):
        for batch in few(batches, 16):
            out = []
            for x, y in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                one = _tree(x)
                two = one if y is None else _tree(y)
                found = list(tree_join(one, two, num, den))
                if not found:
                    continue
                i, j, bound = (np.concatenate(v) for v in zip(*found, strict=True))
                a, b, close = one.refs[i], two.refs[j], bound / (one.levels[0][1][i] + two.levels[0][1][j])
                if only_best:
                    best = np.zeros(len(a), bool)
                    for x, y in ((a, b), (b, a)):
                        order = np.lexsort((y, -close, x))
                        best[order[np.unique(x[order], return_index=True)[1]]] = True
                    a, b, close = a[best], b[best], close[best]
                out.append((np.minimum(a, b), np.maximum(a, b), close))
            if out:
                a, b, close = (np.concatenate(v) for v in zip(*out, strict=True))
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(close[keep])], names=["a", "b", "close"])

    return run


def _bounded(num: int, den: int):
    """The leaves whose point admits a link with the hub's, which comes in a row without leaf before them."""

    def run(batches):
        own = None
        for batch in few(batches):
            leaves, sizes, blobs = (batch.column(c).to_pylist() for c in ("leaf", "n", "point"))
            hubs = [k for k, leaf in enumerate(leaves) if leaf is None]
            keep = []
            for start, end in zip([0, *hubs], [*hubs, len(leaves)], strict=True):
                if start in hubs:
                    own, start = (sizes[start], points(blobs[start : start + 1])), start + 1
                if start < end:
                    n = np.array(sizes[start:end])
                    good = (overlap(points(blobs[start:end]), own[1]) >= need(num, den, n, own[0])) & (den * np.minimum(n, own[0]) >= num * np.maximum(n, own[0]))
                    keep.append(start + np.flatnonzero(good))
            if keep and len(k := np.concatenate(keep)):
                rows = batch.take(pa.array(k))
                yield pa.RecordBatch.from_arrays([rows.column("hub"), rows.column("leaf")], names=["hub", "leaf"])

    return run


def _linked(words: int, num: int, den: int):
    """A row without leaf gives the hub's text; the rows of its leaves follow."""

    def run(batches):
        shingles, own = Shingler(words), None
        for batch in few(batches):
            at, good = [], []
            for k, (leaf, x) in enumerate(zip(batch.column("leaf").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                t = shingles(zstandard.decompress(x).decode())
                if leaf is None:
                    own = t
                    continue
                common = len(np.intersect1d(own, t, assume_unique=True))
                at.append(k)
                good.append(den * common >= num * (len(own) + len(t) - common))
            if at:
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column("hub"), rows.column("leaf"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


def joined(label: DataFrame | None, links: DataFrame, light) -> DataFrame:
    """(ref, label) with further links (a, b): only edges between components known so far are worked through again."""
    if label is None:
        return slim(components(links.select("a", "b")).select(F.col("node").alias("ref"), F.col("component").alias("label")))
    if not links.take(1):
        return label
    ends = links.select("a", "b")
    for c in ("a", "b"):
        names = light(label.select(F.col("ref").alias(c), "label"))
        ends = ends.join(names, c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
    moved = slim(components(ends.where("a <> b")))
    old = label.join(light(moved), label.label == moved.node, "left").select("ref", F.coalesce("component", "label").alias("label"))
    new = moved.join(label.select("ref"), moved.node == F.col("ref"), "left_anti").select(F.col("node").alias("ref"), F.col("component").alias("label"))
    return slim(old.union(new))


class _Join:
    """The steps from cells to components, over the sets of `members`: (cell, ref, n, score)."""

    def __init__(self, members, texts, words, num, den, capacity, leaves, broadcast_rows):
        self.members, self.texts = members, texts
        self.points = slim(texts.select("ref", "n", "point"), 50_000)
        self.words, self.num, self.den, self.capacity, self.leaves, self.broadcast_rows = words, num, den, capacity, leaves, broadcast_rows

    def light(self, df):
        """Broadcast a slim table of checked size; a larger one is joined by a shuffle."""
        return F.broadcast(df) if df.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows else df

    def meet(self, stars, rows):
        """Rows of the leaves of (hub, leaf), behind one of their hub without leaf: a hub goes to a task for each `leaves` of its leaves."""
        parts = stars.groupBy("hub").agg(F.ceil(F.count("*") / self.leaves).alias("m"))
        stars = slim(stars.join(self.light(slim(parts)), "hub").select("hub", F.pmod(F.xxhash64("leaf"), F.col("m")).alias("part"), "leaf"))
        rest = [c for c in rows.columns if c != "ref"]
        top = rows.join(self.light(stars.select("hub", "part").distinct()), rows.ref == F.col("hub")).select("hub", "part", F.lit(None).cast("long").alias("leaf"), *rest)
        under = rows.join(self.light(stars), rows.ref == F.col("leaf")).select("hub", "part", "leaf", *rest)
        return top.union(under).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("leaf").asc_nulls_first())

    def verify(self, stars):
        """(a, b, linked) of (hub, leaf), on the shingles of their texts."""
        said = self.meet(slim(stars), self.texts.select("ref", "text")).select("hub", "leaf", "text").mapInArrow(tidy(_linked(self.words, self.num, self.den)), "a long, b long, linked boolean")
        return slim(said.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "linked"))

    def leaders(self):
        """(hub, leaf): of every cell all sets hang on the most central one, as far as their points admit a link."""
        best = self.members.groupBy("cell").agg(F.max_by("ref", "score").alias("hub"))
        stars = self.members.join(self.light(slim(best)), "cell").where("ref <> hub").select("hub", F.col("ref").alias("leaf")).distinct()
        return self.meet(slim(stars), self.points).select("hub", "leaf", "n", "point").mapInArrow(tidy(_bounded(self.num, self.den)), "hub long, leaf long")

    def candidates(self, label, only_best: bool):
        """(a, b) of different labels in one cell that may link, by the trees; a cell of two has been seen through its leader."""
        named = self.members.join(self.light(label), "ref", "left").select("cell", "ref", "n", F.coalesce("label", "ref").alias("label"))
        mixed = named.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x < y and m > 2").select("cell")
        order = ("cell", "label", "n", "ref")
        open_rows = slim(named.join(self.light(slim(mixed)), "cell")).join(self.points.select("ref", "point"), "ref")
        packed = open_rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "point")
        blocks = slim(packed.mapInArrow(tidy(_pack(self.capacity)), "cell long, block long, low long, high long, label long, top array<int>, data binary"), 500)
        heads = slim(blocks.drop("data"))
        cells = heads.groupBy("cell").count().where("count > 1").select("cell")
        heads = heads.join(cells, "cell", "left_semi")
        x, y = heads.alias("x"), heads.alias("y")
        low = lambda p, q: F.greatest(f"{p}.low", F.ceil(F.col(f"{q}.low") * self.num / self.den))
        pairs = x.join(y, F.expr(f"x.cell = y.cell and x.block < y.block and {self.den}L * y.high >= {self.num}L * x.low and {self.den}L * x.high >= {self.num}L * y.low and (x.label <> y.label or x.label = -1)"))
        bound = F.aggregate(F.zip_with("x.top", "y.top", lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda s, v: s + v)
        pairs = pairs.where(bound * (self.num + self.den) >= self.num * (low("x", "y") + low("y", "x"))).select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))
        alone = blocks.where("label = -1").select(F.col("data").alias("one"), F.lit(None).cast("binary").alias("two"))
        pairs = slim(pairs)
        if pairs.take(1):
            side = lambda k, c: blocks.select(F.col("block").alias(k), F.col("data").alias(c))
            alone = alone.union(side("i", "one").join(pairs, "i").join(side("j", "two"), "j").select("one", "two"))
        found = alone.mapInArrow(tidy(_searched(self.num, self.den, only_best)), "a long, b long, close double")
        if only_best:
            ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q"), "close"), F.struct(F.col("b").alias("p"), F.col("a").alias("q"), "close"))).alias("x")).select("x.*")
            found = ends.groupBy("p").agg(F.max_by("q", "close").alias("q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        return found.select("a", "b").distinct()

    def as_stars(self, pairs):
        """(hub, leaf): the end with more pairs is the hub."""
        pairs = slim(pairs)
        degree = slim(pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").count())
        for c in ("a", "b"):
            pairs = pairs.join(self.light(degree.select(F.col("x").alias(c), F.col("count").alias(f"n{c}"))), c)
        first = F.col("na") >= F.col("nb")
        return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf"))

    def labels(self):
        """(ref, label) of the sets that link with another."""
        known = fresh = self.verify(self.leaders())
        label = None
        for only_best in (True, False):
            label = joined(label, fresh.where("linked"), self.light)
            more = self.candidates(label, only_best).join(known.select("a", "b"), ["a", "b"], "left_anti")
            fresh = self.verify(self.as_stars(more))
            known = known.union(fresh)
        return joined(label, fresh.where("linked"), self.light)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, num: int = 85, den: int = 100, capacity: int = 512, leaves: int = 64, hot: int = 4096, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(key, n_shingles, component_id): of every row its set's size and the smallest key reachable by links.

    Two rows link when den * |intersection| >= num * |union|. Keys are of an integer type and, so that
    components have names, not null; rows with a null key are returned with a null component. Only key and
    text are read, so other columns may have any name. A tie for the centre of a cell goes by a hash.
    A shingle in more than `hot` sets is dealt over several tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    both = slim(rows.mapInArrow(tidy(_digests(words, to_arrow_type(kind))), f"key {kind.simpleString()}, n long, ra long, rb long, slice int, counts binary"))
    digests = both.where("slice = -1")
    slices = both.where("slice >= 0").select("slice", "counts").groupBy("slice").applyInArrow(_sum_slices, "slice int, counts binary")
    df = np.zeros(1 << DF_BITS, np.uint32)
    for r in slices.collect():  # 2^20 counts, whatever the corpus
        df[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, np.uint32)
    table = spark.sparkContext.broadcast(df)

    def light(df):
        return F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df

    # A class of equal sets has a number of its own (ref) from here on; its digest is needed no more.
    classes = digests.where("ra is not null and key is not null").groupBy("ra", "rb").agg(F.min("key").alias("rep"))
    classes = cut(classes.withColumn("ref", F.monotonically_increasing_id()))
    tokens = rows.select("text").mapInArrow(tidy(_prefixes(words, num, den, table, hot)), "tok long, salt long, ra long, rb long, n int")
    # One shuffle by shingle: where no salt splits it, only sets stay that share it with one near enough in size.
    own, sized = W.partitionBy("tok", "salt"), W.partitionBy("tok", "salt").orderBy("n")
    ends = {"a0": F.min("ra"), "a1": F.max("ra"), "b0": F.min("rb"), "b1": F.max("rb")}
    several = "(a0 < a1 or b0 < b1)"
    seen = tokens.withColumns({"before": F.lag("n").over(sized), "after": F.lead("n").over(sized)}).withColumns({c: x.over(own) for c, x in ends.items()})
    seen = slim(seen.where(f"salt >= 0 or {several} and ({den}L * before >= {num}L * n or {den}L * n >= {num}L * after)").select("tok", "salt", "ra", "rb", "n"))
    split = seen.where("salt >= 0")
    split = split.join(light(slim(split.groupBy("tok").agg(*[x.alias(c) for c, x in ends.items()]).where(several).select("tok"))), "tok").select("tok", "ra", "rb", "n")
    refs = light(classes.select("ra", "rb", "ref"))
    held = slim(seen.where("salt < 0").select("tok", "ra", "rb", "n").union(split).join(refs, ["ra", "rb"]).select("tok", "ref", "n").distinct())
    # Of cells with the same sets one is kept.
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "ref"), F.lit((1 << 31) - 1)))
    cells = held.groupBy("tok").agg(part(1).alias("s"), part(2).alias("t"), F.count("*").alias("m")).where("m > 1")
    cells = slim(cells.groupBy("s", "t", "m").agg(F.min("tok").alias("tok")).select("tok"))
    # A set is central in its cells as far as its prefix is shared with others.
    length = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    score = (F.floor(F.col("k") * 1024 / length) * (1 << 40) + F.pmod(F.xxhash64("ref"), F.lit(1 << 40))).alias("score")
    central = slim(held.groupBy("ref", "n").agg(F.count("*").alias("k")).select("ref", score))
    members = slim(held.join(light(cells), "tok").join(light(central), "ref").select(F.col("tok").alias("cell"), "ref", "n", "score"))
    if members.take(1):
        taking = slim(members.select("ref").distinct().join(classes, "ref"))
        texts = rows.join(light(taking), F.col("key") == F.col("rep")).select("ref", "ra", "rb", "text").where("text is not null")
        texts = cut(texts.mapInArrow(tidy(_zip_text(words)), "ref long, n long, point binary, text binary"))
        reach = _Join(members, texts, words, num, den, capacity, leaves, broadcast_rows).labels().join(classes.select("ref", "rep"), "ref")
        least = reach.groupBy("label").agg(F.min("rep").alias("component"))
        named = classes.join(reach.join(light(slim(least)), "label").select("ref", "component"), "ref", "left")
        named = named.select("ra", "rb", F.coalesce("component", "rep").alias("component"))
    else:
        named = classes.select("ra", "rb", F.col("rep").alias("component"))
    out = digests.select("key", "n", "ra", "rb").join(named, ["ra", "rb"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").cast("long").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs whose key is the smallest of its component, one of each group, with the columns of docs, whatever their names.

    Among rows that repeat a kept key the first by a hash of its columns stays; rows with a null key are in no group and stay.
    Null and empty texts link with nothing and stay; an empty table gives no rows.
    """
    groups = join(docs, key, **kw)
    most = kw.get("broadcast_rows", 1_000_000)
    gone, place = unused(docs, "gone"), unused(docs, "place")
    ids = slim(groups.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(gone)).agg(F.max(F.col(key) == F.col("component_id")).alias("first")).where("not first").select(gone))
    ids = F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
    once = docs.join(ids, F.col(key) == F.col(gone), "left_anti")
    if docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
        once = once.where(F.col(key).isNotNull()).withColumn(place, rank).where(F.col(place) == 1).drop(place).union(once.where(F.col(key).isNull()))
    return once
