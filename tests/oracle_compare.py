"""Run queries beside their SQL and compare rows: python tests/oracle_compare.py [sf_dir] [name…]."""

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def duck_rows(c, sql):
    t = c.execute(sql).fetch_arrow_table() if hasattr(c, "fetch_arrow_table") else c.sql(sql).to_arrow_table()
    cols = sorted(t.column_names)
    return cols, sorted(tuple(norm(r[k]) for k in cols) for r in t.to_pylist())


def compare(spark, sf_dir, names=None):
    import __spark_entry__ as e

    c, bad, q = duck(sf_dir), [], e.queries()
    for name, sql in e.oracle_sql().items():
        if names and name not in names:
            continue
        try:
            a = spark_rows(q[name](spark, sf_dir))
            b = duck_rows(c, sql)
        except Exception as x:
            bad.append((name, str(x)[:400]))
            continue
        if a != b:
            only = [r for r in a[1] if r not in set(b[1])][:2], [r for r in b[1] if r not in set(a[1])][:2]
            bad.append((name, f"{a[0]} {b[0]} rows {len(a[1])} {len(b[1])} {only}"[:600]))
        elif not a[1]:
            bad.append((name, "no rows"))
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    found = compare(s, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", set(sys.argv[2:]))
    for x in found:
        print(*x)
    print(len(found), "differ")
