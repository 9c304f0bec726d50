"""The Katz model against a plain Python version with dictionaries, and its normalisation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import katz, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, BEGIN = object(), object()


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def good_turing(counts):
    n = Counter(counts.values())
    for top in range(5, 1, -1):
        if all(n[r] for r in range(1, top + 2)):
            g = (top + 1) * n[top + 1] / n[1]
            d = {r: ((r + 1) * n[r + 1] / n[r] / r - g) / (1 - g) for r in range(1, top + 1)} if g < 1 else {}
            if d and all(0 < x < 1 for x in d.values()):
                return lambda r: d.get(r, 1.0)
    return lambda r: 0.5 if r == 1 else 1.0


class Brute:
    def __init__(self, texts):
        self.uni, self.bi, self.after = Counter(), Counter(), defaultdict(set)
        for t in texts:
            w = words(t)
            self.uni.update(w)
            for h, x in zip([BEGIN, *w], w):
                self.bi[h, x] += 1
                self.after[h].add(x)
        self.n, self.d1, self.d2 = sum(self.uni.values()), good_turing(self.uni), good_turing(self.bi)
        left = self.n - sum(self.d1(c) * c for c in self.uni.values())
        self.below = self.n if left > 1e-12 else self.n + 1
        self.unseen = (left if left > 1e-12 else 1) / self.below
        self.total, self.alpha = {}, {}
        for h, seen in self.after.items():
            total = sum(self.bi[h, x] for x in seen)
            kept = sum(self.d2(self.bi[h, x]) * self.bi[h, x] for x in seen)
            self.total[h] = total if total - kept > 1e-12 else total + 1
            self.alpha[h] = (1 - kept / self.total[h]) / (1 - sum(self.p1(x) for x in seen))

    def p1(self, x):
        return self.d1(self.uni[x]) * self.uni[x] / self.below if self.uni[x] else self.unseen

    def p(self, h, x):
        if c := self.bi[h, x]:
            return self.d2(c) * c / self.total[h]
        return self.alpha.get(h, 1.0) * self.p1(x)

    def score(self, text):
        w = words(text)
        base = sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1))) for x in w)
        return len(w), sum(self.uni[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(h, x)) for h, x in zip([BEGIN, *w], w))


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def check(rows, docs):
    model = Brute([t for k, t in docs if not held(k)])
    assert len(rows) == len(docs)
    want = sorted((str(k), held(k), *model.score(t)) for k, t in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9), (a, b)
    return model


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    model = check(queries.op11_katz_scores(spark, sf).collect(), docs)
    # P(.|h) sums to one over the vocabulary and the unseen word, for seen and unseen histories
    for h in [BEGIN, "the", "no such history", *list(model.after)[5:8]]:
        assert sum(model.p(h, x) for x in [*model.uni, "no such word"]) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize(("block", "part"), [(60, 1000), (10**6, 10**6)])
def test_edges_and_splits(spark, block, part):
    """Nulls, empty and long texts, odd white space, capitals outside A-Z, repeated rows, clashing names, many blocks and parts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(vocabulary[int(x)] for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 60)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \t\n\x0b\x0c\r "), (103, "ÄB äb x \x1f 　"), (103, "A b A b"), (103, "A b A b"), (None, "a b"), (6, "w1 " * 5000), (104, "x"), (104, "x" * 70_000)]
    df = spark.createDataFrame([(k, t, "c", 1, "n") for k, t in docs], "doc_id long, text string, block string, train int, tokens string").repartition(5)
    out = katz.score(df, ~katz.held_out(), block_tokens=block, part_chars=part)
    check(out.collect(), docs)


def test_hot_word_and_empty(spark):
    docs = [(i, "hot " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(katz.score(df, ~katz.held_out(), block_tokens=500, part_chars=1000).collect(), docs)
    assert katz.score(df.limit(0), ~katz.held_out()).collect() == []
    untrained = katz.score(df, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in untrained)


def test_packing():
    for v in ([], [0], [2**64 - 1, 0, 5], list(range(1000))):
        a = np.array(v, dtype=np.uint64)
        assert katz.unpack(katz.pack(a)).tolist() == v
        assert katz.unpack_sorted(katz.pack_sorted(np.sort(a))).tolist() == sorted(v)
    flat, n = katz.tokens(pa.array([None, " A  b", "", "c "]))
    assert flat.to_pylist() == ["a", "b", "c"] and n.tolist() == [0, 2, 0, 1]


def test_blocks_are_shuffled_once(spark):
    """The checkpointed blocks keep their partitioning, so meeting the answers shuffles the answers only."""
    df = spark.createDataFrame([(i, f"a{i % 7} b c") for i in range(100)], "doc_id long, text string")
    out = katz.score(df, ~katz.held_out(), block_tokens=50, part_chars=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1, plan
