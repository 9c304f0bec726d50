"""Language-model scores: a Katz backoff bigram model, counted, stored and evaluated by key ranges.

Tokens are the words of a text, A-Z in lower case, and one end; the first token's history is a begin
mark. A count r <= K is discounted by Good-Turing, d_r = (r*/r - g) / (1 - g) with r* = (r+1) n_(r+1)/n_r
and g = (K+1) n_(K+1)/n_1. If that isn't within (0, 1) for each r, a smaller K (at least 2) is tried, then
only singletons are discounted, by half. P(w|h) = d c(hw) / c(h) where hw was seen, else alpha(h) P(w), and
alpha(h) = (1 - sum of P(w|h)) / (1 - sum of P(w)) over the w seen after h, so P(.|h) sums to one. Words never
seen are one outcome that has the unigrams' discounted mass. A history (or the unigrams) without
discounted followers has one more in its denominator, as it must leave mass too. After a history
never seen alpha is 1. A model of no tokens gives each token probability 1.

Counts are of all training rows and all tokens; nothing is pruned. Steps:
1. blocks: a task turns texts into blocks of numbered tokens, which are dealt by number and checkpointed.
2. every block asks, for each of its distinct unigrams and bigrams, sorted by a 64-bit hash, for its training
   count; keys go to the part (a range of hashes) that they lie in, as packed arrays. A key is sent once by a block, so
   the most frequent word costs a part one entry a block. A part adds up counts, writes its rows of
   the table `ngrams`, and answers; one of the blocks that ask, the first that trains on the bigram, is told that it owns it.
3. a block sums, for each history, the followers that it owns: their numbers by count, and their P(w). Parts
   add these up to the table `weights` with alpha(h), and answer the blocks that need one.
4. a block looks every token up: bigram, else weight and unigram.
Parts and blocks are sized by parameters, and their numbers grow with the text. The driver has counts of counts.
Keys are hashes of 64 bits: among 10^10 different words two or three pairs collide and are one word.

A null or empty text is one end. Null keys train unless a rule says else. Repeated rows are rows of their own.
No rows give no rows. Columns other than key, text and train are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, cut, shared_dir, shuffle_partitions, tidy

by_value(__name__)

K = 5
BLOCK_TOKENS = 4_000_000
PART_CHARS = 32_000_000
ASKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ord", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SPARK_ASKS = "block long, part int, ord int, keys binary, counts binary"


def held_out(key: str = "doc_id", remainder: int = 1) -> Column:
    """The fifth of the documents that nothing is learned from; a null key is not in it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def pack(values: np.ndarray) -> bytes:
    """Integers from 0 to 2^64 - 1 as byte planes, without leading planes of zeros, compressed."""
    import zstandard

    v = np.ascontiguousarray(values.astype("<u8"))
    width = (int(v.max(initial=0)).bit_length() + 7) // 8 or 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(v).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    width, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:], max_output_size=max(1, n * width)), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range begins in sorted keys, and the end."""
    return np.searchsorted(keys >> np.uint64(32), np.array([-(-(p << 32) // parts) for p in range(parts)] + [1 << 32], dtype=np.uint64))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in order, number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat, at = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    good = pc.greater(pc.binary_length(flat), 0)
    upto = np.r_[0, np.cumsum(good.to_numpy(zero_copy_only=False))]
    return flat.filter(good), np.diff(upto[at - at[0]])


class Block:
    """Numbered tokens of a block: `cur` and `prev` by place, `hash` by number; numbers V - 2 and V - 1 are end and begin."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, lens: np.ndarray):
        import xxhash

        ends = [xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\t")]
        self.hash, self.lens = np.r_[hashes, np.array(ends, dtype=np.uint64)], lens + 1
        end, begin = len(hashes), len(hashes) + 1
        self.cur = np.full(int(self.lens.sum()), end, dtype=np.int64)
        stop = np.cumsum(self.lens)
        word = np.ones(len(self.cur), dtype=bool)
        word[stop - 1] = False
        self.cur[word] = ids
        self.prev = np.r_[begin, self.cur[:-1]] if len(self.cur) else self.cur
        self.starts = stop - self.lens
        self.prev[self.starts] = begin
        # distinct unigrams (all numbers but begin) and bigrams, each in order of their keys
        self.uni = np.argsort(self.hash[:-1])
        pairs, self.which = np.unique(self.prev * len(self.hash) + self.cur, return_inverse=True)
        keys = mixed(self.hash[pairs // len(self.hash)], self.hash[pairs % len(self.hash)])
        order = np.argsort(keys)
        self.keys = [self.hash[self.uni], keys[order]]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.which, pairs = rank[self.which], pairs[order]
        self.first, self.second = pairs // len(self.hash), pairs % len(self.hash)


def _load(row: dict) -> tuple[Block, np.ndarray]:
    return Block(unpack(row["hashes"]), unpack(row["tokens"]).astype(np.int64), unpack(row["lens"]).astype(np.int64)), unpack(row["train"]).astype(bool)


def blocks(docs: DataFrame, key: str, text: str, train: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, ids, train, lens, hashes, tokens): texts as numbered words, about block_tokens of them together; a text is never split."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        held, n, made = [], 0, 0

        def out():
            coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
            numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.empty(len(hashes), dtype=np.int64)
            by_count = np.argsort(-np.bincount(numbers, minlength=len(hashes)), kind="stable")
            rank[by_count] = np.arange(len(hashes))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(TaskContext.get().partitionId() << 24) + made], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, sum(len(h[1]) for h in held)], pa.int32()), pa.concat_arrays([h[1] for h in held])),
                "train": [pack(np.concatenate([h[2] for h in held]))], "lens": [pack(np.concatenate([h[3] for h in held]))], "hashes": [pack(hashes[by_count])], "tokens": [pack(rank[numbers])],
            })

        for batch in batches:
            if batch.num_rows:
                words, lens = tokens(batch.column("text"))
                held.append((words, batch.column("id"), batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint64), lens))
                n += int(lens.sum()) + batch.num_rows
                if n >= block_tokens:
                    yield out()
                    held, n, made = [], 0, made + 1
        if held:
            yield out()

    binary = T.BinaryType()
    return rows.mapInArrow(tidy(run), T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, binary) for c in ("train", "lens", "hashes", "tokens")]]))


def _sliced(block: int, ord: int, keys: np.ndarray, parts: int, *values: np.ndarray):
    """(part, block, ord, packed keys, packed values …) of the parts that have keys."""
    at = cuts(keys, parts)
    for p in np.flatnonzero(np.diff(at)).tolist():
        s = slice(at[p], at[p + 1])
        yield (p, block, ord, pack_sorted(keys[s]), *[pack(v[s]) for v in values])


def ask(table: DataFrame, parts: int) -> DataFrame:
    """Every block's distinct n-grams with their counts in its training texts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b, train = _load(row)
                taught = np.repeat(train, b.lens)
                c1 = np.bincount(b.cur[taught], minlength=len(b.hash))[b.uni]
                c2 = np.bincount(b.which[taught], minlength=len(b.keys[1]))
                for ord, (keys, c) in enumerate(zip(b.keys, (c1, c2), strict=True), 1):
                    rows = list(_sliced(row["block"], ord, keys, parts, c))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]), ASKS.types, strict=True)], schema=ASKS)

    return table.drop("ids").mapInArrow(tidy(run), SPARK_ASKS)


def _grouped(batches, *columns):
    """{(part, ord): [rows by block]} of all batches: what one part holds."""
    out: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            out.setdefault((row["part"], row["ord"]), []).append(row)
    return {k: sorted(v, key=lambda r: r["block"]) for k, v in sorted(out.items())}


def tally(asks: DataFrame, parts: int) -> DataFrame:
    """Rows as asks: with a null block the part's n-grams and counts (the model), with a block the counts it asked for, times two, plus one where it owns the n-gram."""

    def run(batches):
        for (part, ord), rows in _grouped(batches).items():
            keys, counts = [unpack_sorted(r["keys"]) for r in rows], [unpack(r["counts"]) for r in rows]
            at = np.r_[0, np.cumsum([len(k) for k in keys])]
            every, many = np.concatenate(keys), np.concatenate(counts)
            del keys, counts
            order = np.argsort(every, kind="stable")
            new = np.r_[True, every[order][1:] != every[order][:-1]]
            group = np.cumsum(new) - 1
            totals = np.add.reduceat(many[order], np.flatnonzero(new))
            teach = np.flatnonzero(many[order] > 0)
            owns = np.zeros(len(every), dtype=np.uint64)
            if len(teach):
                owns[order[teach[np.r_[True, group[teach][1:] != group[teach][:-1]]]]] = 1
            answer = np.empty(len(every), dtype=np.uint64)
            answer[order] = totals[group] * np.uint64(2)
            answer += owns
            seen = totals > 0
            out = [(None, part, ord, pack_sorted(every[order][new][seen]), pack(totals[seen]))]
            del every, order, group
            out += [(r["block"], part, ord, None, pack(answer[a:z])) for r, a, z in zip(rows, at[:-1], at[1:], strict=True)]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 64], strict=True), ASKS.types, strict=True)], schema=ASKS)

    return asks.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), SPARK_ASKS)


def counts_of_counts(ngrams: DataFrame) -> dict[int, dict]:
    """{order: {"n": tokens, "v": distinct, 1: n_1, …, K + 1: n_(K+1)}}."""

    def run(batches):
        for batch in batches:
            for ord, c in zip(batch.column("ord").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                v = unpack(c)
                yield pa.RecordBatch.from_pydict({"ord": pa.array([ord] * (K + 3), pa.int32()), "r": pa.array([-1, 0, *range(1, K + 2)], pa.int32()), "n": pa.array([int(v.sum()), len(v), *[int((v == r).sum()) for r in range(1, K + 2)]], pa.int64())})

    got = ngrams.select("ord", "counts").mapInArrow(tidy(run), "ord int, r int, n long").groupBy("ord", "r").agg(F.sum("n").alias("n")).collect()  # 2 (K + 3) numbers
    out: dict[int, dict] = {o: {"n": 0, "v": 0} | dict.fromkeys(range(1, K + 2), 0) for o in (1, 2)}
    for r in got:
        out[r.ord][{-1: "n", 0: "v"}.get(r.r, r.r)] = r.n
    return out


def discounts(n: dict, k: int = K) -> list[float]:
    """[d_0 .. d_k, 1]: factors for counts up to k and, last, for all above."""
    for top in range(k, 1, -1):
        if all(n[r] > 0 for r in range(1, top + 2)):
            g = (top + 1) * n[top + 1] / n[1]
            if g < 1:
                d = [((r + 1) * n[r + 1] / (n[r] * r) - g) / (1 - g) for r in range(1, top + 1)]
                if all(0 < x < 1 for x in d):
                    return [1.0, *d, *[1.0] * (k - top), 1.0]
    return [1.0, 0.5, *[1.0] * k] if n[1] else [1.0] * (k + 2)


class Unigrams:
    """P(w) by count, for the unseen too."""

    def __init__(self, n: dict, k: int = K):
        self.d, self.total, self.v = np.array(discounts(n, k)), n["n"], n["v"]
        left = sum((1 - self.d[r]) * r * n[r] for r in range(1, k + 1))
        self.below = self.total if left > 0 else self.total + 1
        self.unseen = (left or 1.0) / self.below

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, len(self.d) - 1)] * c / self.below, self.unseen)


def _answers(table: pa.Table, ord: int) -> np.ndarray:
    """What all parts answered, in order of the keys."""
    rows = sorted((p, v) for p, o, v in zip(table.column("part").to_pylist(), table.column("ord").to_pylist(), table.column("counts").to_pylist(), strict=True) if o == ord)
    return np.concatenate([unpack(v) for _, v in rows]) if rows else np.zeros(0, dtype=np.uint64)


def _followers(b: Block, answers: pa.Table):
    """(count of each token number, with begin's as the end's; count and ownership of each bigram)."""
    c1 = np.zeros(len(b.hash), dtype=np.int64)
    c1[b.uni] = (_answers(answers, 1) >> np.uint64(1)).astype(np.int64)
    c1[-1] = c1[-2]
    two = _answers(answers, 2)
    return c1, (two >> np.uint64(1)).astype(np.int64), (two & np.uint64(1)).astype(bool)


WEIGHT_ASKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ord", pa.int32()), ("keys", pa.binary()), ("totals", pa.binary()), ("by_count", pa.list_(pa.binary())), ("mass", pa.binary()), ("wanted", pa.binary())])
SPARK_WEIGHT_ASKS = "block long, part int, ord int, keys binary, totals binary, by_count array<binary>, mass binary, wanted binary"
WEIGHTS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ord", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("alpha", pa.binary())])
SPARK_WEIGHTS = "block long, part int, ord int, keys binary, counts binary, alpha binary"


def _wants(b: Block, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Histories whose weight a block needs: seen ones with an unseen follower here, or without a small count here."""
    least = np.full(len(b.hash), np.iinfo(np.int64).max)
    np.minimum.at(least, b.first, c2)
    there = np.zeros(len(b.hash), dtype=bool)
    there[b.first] = True
    return there & (c1 > 0) & ((least == 0) | (least > K))


def histories(table: DataFrame, answers: DataFrame, one: Unigrams, parts: int) -> DataFrame:
    """A block's share in the weights of its histories, and which of them it needs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b, _ = _load(row)
            c1, c2, own = _followers(b, right)
            need, size = _wants(b, c1, c2), len(b.hash)
            first, c = b.first[own], c2[own]
            by_count = [np.bincount(first[c == r], minlength=size) for r in range(1, K + 1)]
            mass = np.bincount(first, weights=one.p(c1)[b.second[own]], minlength=size)
            use = np.flatnonzero(need | (np.bincount(first, minlength=size) > 0))
            use = use[np.argsort(b.hash[use])]
            keys = b.hash[use]
            at = cuts(keys, parts)
            for p in np.flatnonzero(np.diff(at)).tolist():
                s = use[at[p] : at[p + 1]]
                out.append((row["block"], p, 2, pack_sorted(keys[at[p] : at[p + 1]]), pack(c1[s]), [pack(x[s]) for x in by_count], mass[s].astype("<f8").tobytes(), pack(need[s])))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(WEIGHT_ASKS.types)], schema=WEIGHT_ASKS)

    return table.drop("ids").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(run), SPARK_WEIGHT_ASKS)


def weigh(shares: DataFrame, two: list[float], one: Unigrams, parts: int) -> DataFrame:
    """Rows with a null block are the part's histories, their counts and weights (the model); with a block the weights it needs, negative where the denominator has one more."""
    d = np.array(two)

    def run(batches):
        for (part, ord), rows in _grouped(batches).items():
            keys = [unpack_sorted(r["keys"]) for r in rows]
            at, every = np.r_[0, np.cumsum([len(k) for k in keys])], np.concatenate(keys)
            uniq, where = np.unique(every, return_inverse=True)
            total = np.zeros(len(uniq), dtype=np.int64)
            total[where] = np.concatenate([unpack(r["totals"]) for r in rows]).astype(np.int64)
            left = np.zeros(len(uniq))
            for r in range(1, K + 1):
                left += (1 - d[r]) * r * np.bincount(where, weights=np.concatenate([unpack(x["by_count"][r - 1]) for x in rows]).astype(np.float64), minlength=len(uniq))
            mass = np.bincount(where, weights=np.concatenate([np.frombuffer(r["mass"], "<f8") for r in rows]), minlength=len(uniq))
            more = left <= 0
            alpha = np.where(more, 1.0, left) / (total + more) / np.maximum(1 - mass, one.unseen)
            alpha = np.where(more, -alpha, alpha)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, part, ord, pack_sorted(uniq), pack(total), alpha.astype("<f8").tobytes()), WEIGHTS.types, strict=True)], schema=WEIGHTS)
            for r, a, z in zip(rows, at[:-1], at[1:], strict=True):
                need = unpack(r["wanted"]).astype(bool)
                if need.any():
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((r["block"], part, ord, None, None, alpha[where[a:z]][need].astype("<f8").tobytes()), WEIGHTS.types, strict=True)], schema=WEIGHTS)

    return shares.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), SPARK_WEIGHTS)


def tidy_pair(run):
    """tidy() for a cogrouped function."""

    def tidied(left, right):
        (out,) = tidy(lambda _: iter([run(left, right)]))(None)
        return out

    return tidied


def evaluate(table: DataFrame, answers: DataFrame, key: str, one: Unigrams, two: list[float]) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind, d = table.schema["ids"].dataType.elementType, np.array(two)
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (kind, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()), strict=True)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row in left.to_pylist():
            b, train = _load(row)
            c1, c2, _ = _followers(b, right)
            need = np.flatnonzero(_wants(b, c1, c2))
            need = need[np.argsort(b.hash[need])]
            given = sorted((p, a) for p, a in zip(right.column("part").to_pylist(), right.column("alpha").to_pylist(), strict=True) if a is not None)
            alpha = np.ones(len(b.hash))
            alpha[need] = np.concatenate([np.frombuffer(a, "<f8") for _, a in given]) if given else np.zeros(0)
            below = np.maximum(c1 + (alpha < 0), 1)
            p1 = one.p(c1)
            p = np.where(c2 > 0, d[np.minimum(c2, K + 1)] * c2 / below[b.first], np.abs(alpha)[b.first] * p1[b.second])
            sums = lambda x: np.add.reduceat(x, b.starts)  # noqa: E731  every text has a token
            base = np.log10((c1 + 0.5) / (one.total + 0.5 * (one.v + 1)))
            made.append([left.column("ids").combine_chunks().flatten() if left.num_rows == 1 else pa.array(row["ids"]), ~train, b.lens, sums((c1[b.cur] > 0).astype(np.int64)), np.full(len(b.lens), one.total), sums(base[b.cur]), sums(np.log10(p)[b.which])])
        return pa.Table.from_arrays([pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in column]) for column in zip(*made, strict=True)], names=names)

    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(run), schema)


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """df in n partitions by key, checkpointed so that later plans know how it is partitioned and need not shuffle it again. Adaptive plans don't tell."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(n, key))
    finally:
        conf.set(name, before)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", to: str | None = None, block_tokens: int = BLOCK_TOKENS, part_chars: int = PART_CHARS) -> DataFrame:
    """Train on the rows where `train` holds, score all rows. Tables `ngrams` and `weights`, in folders by order and part, are left below `to` (a new shared folder if not given).

    held_out is true where train doesn't hold.
    """
    spark, to = docs.sparkSession, to or f"{shared_dir(docs.sparkSession)}/katz-{uuid.uuid4().hex}"
    parts = max(1, -(-int(docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0) // part_chars))
    table = dealt(blocks(docs, key, text, train, block_tokens), max(parts, shuffle_partitions(spark)), "block")

    def stored(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(model, answers), written and read again."""
        df.withColumn("kind", F.when(F.col("block").isNull(), "model").otherwise("answer")).write.partitionBy("kind", "ord").parquet(f"{to}/{name}")
        back = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("kind", T.StringType())])).parquet(f"{to}/{name}")
        return back.where("kind = 'model'").drop("block", "kind"), back.where("kind = 'answer'").drop("kind", "keys")

    ngrams, counts = stored(tally(ask(table, parts), parts), "ngrams")
    n = counts_of_counts(ngrams)
    one, two = Unigrams(n[1]), discounts(n[2])
    _, alphas = stored(weigh(histories(table, counts, one, parts), two, one, parts), "weights")
    both = counts.select("block", "part", "ord", "counts", F.lit(None).cast("binary").alias("alpha")).unionByName(alphas.select("block", "part", F.lit(3).alias("ord"), "counts", "alpha"))
    return evaluate(table, both, key, one, two)
