"""The co-bucketed pair against a brute-force version in plain Python, with few and many passes."""

import glob
import hashlib
import os
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamina.llm import cobucket, queries
from lamina.llm.common import shared_dir

N = 300


def crc(text):
    return zlib.crc32(text.encode()) % N


def order(row):
    return tuple((v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0) for v in row)


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def brute(sales, lines):
    """{(table, bucket): (rows in order, columns, ids, lineage, n_joined, rewritten)} from lists of tuples in column order."""
    b = lambda k: N + 1 if k is None else crc(f"line{k}")
    known = {r[0] for r in sales if r[0] is not None}
    start = {"sales": lambda r: b(r[0]) - (b(r[0]) % 3 == 1), "sale_lines": lambda r: 0 if r[2] is None else crc(str(r[2]))}
    final = {"sales": lambda r: b(r[0]), "sale_lines": lambda r: N + 1 if r[0] is None else b(r[0]) if r[0] in known else N}
    out = {}
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        begun, ended = {}, {}
        for r in rows:
            begun.setdefault(start[name](r), []).append(r)
            ended.setdefault(final[name](r), []).append(r)
        for k, own in ended.items():
            own = sorted(own, key=order)
            come = sorted({start[name](r) for r in own})
            stays = len(come) == 1 and len(begun[come[0]]) == len(own)
            came = [f"{s}:{sum(start[name](r) == s for r in own)}" for s in come]
            out[name, k] = (own, sha(["" if r[0] is None else str(r[0]) for r in own]), sha(came), not stays)
    joined = lambda k: sum(1 for s in out.get(("sales", k), [[]])[0] for l in out.get(("sale_lines", k), [[]])[0] if s[0] is not None and s[0] == l[0])  # noqa: E731, E741
    return {(t, k): (*v, joined(k)) for (t, k), v in out.items()}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_co_bucketed_pair(spark, sf).collect()
    tables = {t: pq.read_table(f"{sf}/{t}.parquet") for t in ("sales", "sale_lines")}
    want = brute(*[list(zip(*t.to_pydict().values(), strict=True)) for t in tables.values()])
    assert {(r.table_name, r.bucket) for r in rows} == set(want) and len(rows) == len(want)
    folders = set()
    for r in rows:
        own, ids, lineage, rewritten, joined = want[r.table_name, r.bucket]
        path = r.path.removeprefix("file:")
        held = pq.ParquetFile(path).read()
        assert held.column_names == tables[r.table_name].column_names == r.columns.split(",")
        assert list(zip(*held.to_pydict().values(), strict=True)) == own
        assert (r.ids_sha256, r.lineage_sha256, r.n_rows, r.n_joined, r.rewritten) == (ids, lineage, len(own), joined, rewritten), (r.table_name, r.bucket)
        folders.add(os.path.dirname(os.path.dirname(path)))
    (root,) = folders
    there = [f for f in glob.glob(f"{root}/**", recursive=True, include_hidden=True) if os.path.isfile(f)]
    assert sorted(there) == sorted(r.path.removeprefix("file:") for r in rows)
    assert any(not r.rewritten for r in rows) and {r.bucket for r in rows} >= {300, 301}


@pytest.mark.parametrize("fanout", [7])
def test_skew_nulls_and_clashes(spark, fanout):
    """A third of the rows has one key, keys and other columns are null, rows repeat, columns have the names that the operator uses."""
    left = [(i, i % 5, f"s{i % 3}") for i in range(60)] + [(None, 1, "x"), (7, 0, None), (7, 0, None), (7, None, "é")]
    right = [(7, i % 3, i % 11) for i in range(200)] + [(i % 80, 1, None) for i in range(300)] + [(None, i, 1) for i in range(20)] + [(500, 2, 2)] * 50
    a = spark.createDataFrame(left, "k long, number int, file string")
    b = spark.createDataFrame(right, "k long, d0 int, bucket int")
    root, n = f"{shared_dir(spark)}/pair-test-{fanout}", 40
    s = cobucket.lay_out(a, F.coalesce(cobucket.bucket("k", n), F.lit(n + 1)), n + 2, "k", f"{root}/a", fanout)
    t = cobucket.lay_out(b, F.lit(3), n, "k", f"{root}/b", fanout)
    assert set(t) == {3}
    schemas = {"a": a.schema, "b": b.schema}
    lineage, finals = cobucket.co_bucket(spark, root, "a", "b", s, t, schemas, "k", n, "", fanout)
    rows = cobucket.digest(spark, finals, lineage, schemas, "a", "b", "k").collect()
    known = {r[0] for r in left}
    place = lambda k, orphans: n + 1 if k is None else n if orphans and k not in known else zlib.crc32(str(k).encode()) % n
    for name, table, orphans in (("a", left, False), ("b", right, True)):
        own = {}
        for r in table:
            own.setdefault(place(r[0], orphans), []).append(r)
        mine = {r.bucket: r for r in rows if r.table_name == name}
        assert set(mine) == set(own)
        for k, r in mine.items():
            held = pq.ParquetFile(r.path.removeprefix("file:")).read().to_pydict()
            assert list(zip(*held.values(), strict=True)) == sorted(own[k], key=order)
            assert r.rewritten == (name == "b")
    assert sum(r.n_joined for r in rows if r.table_name == "a") == sum(1 for x in left for y in right if x[0] is not None and x[0] == y[0])


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], "k long, v string"), spark.createDataFrame([(1, "x"), (None, "y")], "k long, w string")
    schemas = {"a": a.schema, "b": b.schema}
    root = f"{shared_dir(spark)}/pair-test-empty"
    s, t = cobucket.lay_out(a, F.lit(0), 5, "k", f"{root}/a"), cobucket.lay_out(b, F.lit(0), 5, "k", f"{root}/b")
    lineage, finals = cobucket.co_bucket(spark, root, "a", "b", s, t, schemas, "k", 5, "")
    rows = cobucket.digest(spark, finals, lineage, schemas, "a", "b", "k").collect()
    assert sorted((r.table_name, r.bucket, r.n_rows) for r in rows) == [("b", 5, 1), ("b", 6, 1)]
