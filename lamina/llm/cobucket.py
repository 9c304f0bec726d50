"""A pair of tables rewritten so that equal keys lie in files of equal number: one sorted Parquet file per table and bucket.

Numbers are split into digits of base `fanout`. One pass for each digit but the last refines the
files of the pass before into folders by that digit, with at most `fanout` writers open in a task
(Spark sorts what is left where a task meets more). The last digit deals the rows of one folder to
`fanout` leaf tasks; each sorts its rows, spilling to disk as it must, and writes one file. So no
task, and no step of a shuffle, ever has all numbers open, however many there are.

A key's bucket is crc32(salt + key) mod n. Rows of the right table whose key the left one lacks
go to bucket n, null keys of either table to n + 1. Whether a right key is known is found by a shuffled join of
the right rows with the left's distinct keys; keys with more than 1/2000 of the rows, of which there
can't be 2000, and null keys bypass that join, so a hot key is never dealt to one task before its leaf.
A bucket that holds most rows is sorted and written by one task, streaming, as one file is asked for.

Files hold the table's columns in order, sorted by key, then all other columns left to right, nulls
first; repeated rows stay. There are no files without rows: an empty table has none. Any columns may be
there, whatever their names, as long as Spark can sort them. A starting file whose rows are exactly those of a bucket stays.
The driver handles names of files and counts by number (at most n + 2 of each), nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, cut, tidy, unused

by_value(__name__)

FANOUT = 20
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Leaf jobs that run at a time.
JOBS = 8
#: A key with more than this share of the rows counts as hot.
HOT = 2000


def bucket(key: str | Column, n: int, salt: str = "") -> Column:
    """Unsigned crc32 of salt and the decimal key, mod n; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % n).cast("int")


class Files:
    """What the driver does to files: list, rename, delete."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        at = self.path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be renamed to {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def bare(self, path: str) -> None:
        """Delete checksum files that a local file system keeps beside its files."""
        if hasattr(raw := self.fs, "getRawFileSystem") and self.fs.getScheme() == "file":
            raw = self.fs.getRawFileSystem()
            for s in raw.listStatus(self.path(path)) if raw.exists(self.path(path)) else []:
                if s.getPath().getName().startswith("."):
                    raw.delete(s.getPath(), False)


def _digits(n: int, fanout: int) -> int:
    width = 1
    while fanout**width < n:
        width += 1
    return width


def refine(rows: DataFrame, number: str, n: int, files: Files, work: str, fanout: int = FANOUT) -> tuple[DataFrame, list[tuple[int, str]]]:
    """(rows as read from the last pass, [(leading digits as a number, folder)]): all passes but the leaf's."""
    spark, width = rows.sparkSession, _digits(n, fanout)
    level, names, before = rows, [], None
    for k in range(width - 1):
        name = unused(level, f"d{k}")
        level = level.withColumn(name, (F.floor(F.col(number) / fanout ** (width - 1 - k)) % fanout).cast("int"))
        names.append(name)
        to = f"{work}/pass{k}"
        level.write.option("maxRecordsPerFile", 0).partitionBy(*names).parquet(to)
        level = spark.read.schema(T.StructType([f for f in level.schema if f.name not in names] + [T.StructField(x, T.IntegerType()) for x in names])).parquet(to)
        if before:
            files.delete(before)
        before = to
    found = [(0, before)] if before else []
    for name in names:
        found = [(p * fanout + int(x.split("=")[1]), f"{at}/{x}") for p, at in found for x in files.names(at) if x.startswith(f"{name}=")]
    return level, found


def leaves(level: DataFrame, folders: list[tuple[int, str]], number: str, numbers: set[int], columns: list[str], key: str, files: Files, work: str, to: str, fanout: int = FANOUT) -> dict[int, str]:
    """{number: file}: the rows of the given numbers, one sorted file each, named by `to` with the number in it."""
    spark = level.sparkSession
    stored = T.StructType([f for f in level.schema if f.name in {*columns, number}])
    out: dict[int, str] = {}

    def leaf(prefix: int, folder: str | None) -> None:
        own = {x for x in numbers if x // fanout == prefix}
        if not own:
            return
        rows = level if folder is None else spark.read.schema(stored).parquet(folder)
        rows = rows.where(F.col(number).isin(*own))
        order = [F.col(f"`{c}`").asc_nulls_first() for c in [key, *[c for c in columns if c != key]]]
        dealt = rows.repartitionById(fanout, (F.col(number) % fanout).cast("int")).sortWithinPartitions(*order)
        at = f"{work}/leaf{prefix}"
        dealt.select([F.col(f"`{c}`") for c in columns]).write.option("maxRecordsPerFile", 0).parquet(at)
        for name in files.names(at):
            if name.startswith("part-") and (x := prefix * fanout + int(name.split("-")[1])) in own:
                files.move(f"{at}/{name}", target := to.format(x))
                out[x] = target
        files.delete(at)

    groups = folders or [(0, None)]
    with ThreadPoolExecutor(JOBS) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(leaf), p, f) for p, f in groups]:
            job.result()
    if missing := numbers - out.keys():
        raise OSError(f"no file was written for {sorted(missing)[:5]}")
    return out


class _Writers:
    """While a pass runs, its tasks keep at most `fanout` files open."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.conf, self.fanout = spark.conf, fanout

    def __enter__(self):
        self.before = self.conf.get(WRITERS, None)
        self.conf.set(WRITERS, str(self.fanout))

    def __exit__(self, *_):
        self.conf.unset(WRITERS) if self.before is None else self.conf.set(WRITERS, self.before)


def lay_out(df: DataFrame, number: Column, n: int, key: str, path: str, fanout: int = FANOUT) -> dict[int, str]:
    """{number: file}: df as sorted files `start-<number>.parquet` below path, one for each number from 0 to n - 1 that has rows."""
    files, no, work = Files(df.sparkSession, path), unused(df, "number"), f"{path}/_work-{uuid.uuid4().hex}"
    with _Writers(df.sparkSession, fanout):
        level, folders = refine(df.withColumn(no, number), no, n, files, work, fanout)
        there = {r[0] for r in level.select(no).distinct().collect()}  # at most n
        out = leaves(level, folders, no, there, df.columns, key, files, work, f"{path}/start-{{:05d}}.parquet", fanout)
    files.delete(work)
    return out


def known_keys(right: DataFrame, left: DataFrame, key: str, known: str) -> DataFrame:
    """right with a boolean `known`: whether left has the key; false for null."""
    total = right.count()
    have = left.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    counts = right.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where(f"_k is not null and _n * {HOT} > {total}")
    hot = {r[0]: r[1] for r in counts.join(have.withColumn("_have", F.lit(True)), "_k", "left").select("_k", F.coalesce("_have", F.lit(False))).collect()}  # fewer than HOT keys
    names = [F.col(c) for c in right.columns]
    some, among = right.where(F.col(key).isNotNull()), F.col(key).isin(*hot)
    cold = some.where(~among).join(have, F.col(key) == F.col("_k"), "left").select(*names, F.col("_k").isNotNull().alias(known))
    warm = some.where(among).select(*names, F.col(key).isin(*[k for k, there in hot.items() if there]).alias(known))
    return cold.unionByName(warm).unionByName(right.where(F.col(key).isNull()).select(*names, F.lit(False).alias(known)))


def _rewrite(name: str, rows: DataFrame, columns: list[str], key: str, n: int, starts: dict[int, str], files: Files, path: str, fanout: int) -> tuple[DataFrame, list[tuple]]:
    """((bucket, start, n) of the rows, [(table, bucket, file name, path, rewritten)]); rows have number and start."""
    work = f"{path}/_work-{uuid.uuid4().hex}"
    level, folders = refine(rows, "_number", n + 2, files, work, fanout)
    pairs = cut(level.groupBy(F.col("_number").alias("bucket"), F.col("_start").alias("start")).agg(F.count("*").alias("n")).coalesce(1))  # at most (n + 2)^2 counts
    sole = pairs.groupBy("bucket").agg(F.count("*").alias("starts"), F.min("start").alias("start"))
    wide = pairs.groupBy("start").agg(F.count("*").alias("buckets"))
    found = {r.bucket: r.start if r.starts == 1 and r.buckets == 1 else None for r in sole.join(wide, "start").collect()}
    made = leaves(level, folders, "_number", {b for b, s in found.items() if s is None}, columns, key, files, work, f"{path}/bucket-{{:05d}}.parquet", fanout)
    files.delete(work)
    last = {b: made[b] if s is None else starts[s] for b, s in found.items()}
    return pairs, [(name, b, at.rsplit("/", 1)[1], at, found[b] is None) for b, at in sorted(last.items())]


def co_bucket(spark: SparkSession, root: str, left: str, right: str, left_starts: dict[int, str], right_starts: dict[int, str], schemas: dict[str, T.StructType], key: str, n: int, salt: str, fanout: int = FANOUT) -> tuple[DataFrame, list[tuple]]:
    """Rewrite the starting files of tables `left` and `right` below root by bucket of the key.

    Gives ((table_name, bucket, start, n): how many of a bucket's rows came from each starting file; and
    [(table, bucket, file name, path, rewritten)] of all final files).
    """
    files = Files(spark, root)

    def read(name: str, starts: dict[int, str]) -> DataFrame:
        rows = spark.read.schema(schemas[name]).parquet(*starts.values()) if starts else spark.createDataFrame([], schemas[name])
        no = F.regexp_extract("_metadata.file_name", r"(\d+)\.parquet", 1).cast("int") if starts else F.lit(0)
        return rows.select("*", no.alias("_start"))

    a, b = read(left, left_starts), read(right, right_starts)
    number = F.coalesce(bucket(key, n, salt), F.lit(n + 1))
    b = known_keys(b, a, key, "_known")
    b = b.withColumn("_number", F.when(F.col("_known") | F.col(key).isNull(), number).otherwise(n)).drop("_known")
    tables = (left, a.withColumn("_number", number), left_starts), (right, b, right_starts)
    with _Writers(spark, fanout):
        done = [_rewrite(name, rows, schemas[name].names, key, n, starts, files, f"{root}/{name}", fanout) for name, rows, starts in tables]
    # The right table's rows are told by the left's starting files, so these go when both are done.
    stay = {f[3] for d in done for f in d[1]}
    for at in {*left_starts.values(), *right_starts.values()} - stay:
        files.delete(at)
    for name in (left, right):
        files.bare(f"{root}/{name}")
    return done[0][0].withColumn("table_name", F.lit(left)).unionByName(done[1][0].withColumn("table_name", F.lit(right))), done[0][1] + done[1][1]


def _runs(spark: SparkSession, finals: list[tuple], schema: T.StructType, key: str) -> DataFrame:
    """(file, k, at, n): runs of equal keys in the files, by the row number of their first row. Runs are counted before they are shuffled."""
    if not finals:
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("k", schema[key].dataType), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())]))
    rows = spark.read.schema(schema).parquet(*[f[3] for f in finals]).select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("k"), F.col("_metadata.row_index").alias("row"))
    g = rows.groupBy("file", "k").agg(F.min("row").alias("at"), F.max("row").alias("last"), F.count("*").alias("n"))
    whole = F.when(F.col("last") - F.col("at") + 1 == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("a file is not sorted by its key")).cast("long"))
    return g.select("file", "k", "at", whole.alias("n"))


def _streamed(runs: DataFrame) -> DataFrame:
    """(file, ids_sha256, n_rows): the keys of a file in order, hashed as they stream by."""

    def run(batches):
        now, h, n = None, None, 0

        def out():
            return pa.RecordBatch.from_pydict({"file": [now], "ids_sha256": [h.hexdigest()], "n_rows": [n]}, schema=pa.schema([("file", pa.string()), ("ids_sha256", pa.string()), ("n_rows", pa.int64())]))

        for batch in batches:
            for file, k, many in zip(batch.column("file").to_pylist(), batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if file != now:
                    if now is not None:
                        yield out()
                    now, h, n = file, hashlib.sha256(), 0
                said = b"" if k is None else str(k).encode()
                if n == 0:
                    h.update(said)
                    n, many = 1, many - 1
                n += many
                while many > 0:
                    h.update((b"," + said) * min(many, 4096))
                    many -= 4096
        if now is not None:
            yield out()

    dealt = runs.repartition("file").sortWithinPartitions("file", "at")
    return dealt.select("file", "k", "n").mapInArrow(tidy(run), "file string, ids_sha256 string, n_rows long")


def digest(spark: SparkSession, finals: list[tuple], lineage: DataFrame, schemas: dict[str, T.StructType], left: str, right: str, key: str) -> DataFrame:
    """A row for every final file, from what is in the files: counts, keys in order, lineage, and the rows of the bucket's inner join."""
    files = spark.createDataFrame(finals, "table_name string, bucket long, file string, path string, rewritten boolean")
    columns = F.when(F.col("table_name") == left, ",".join(schemas[left].names)).otherwise(",".join(schemas[right].names))
    runs = {t: cut(_runs(spark, [f for f in finals if f[0] == t], schemas[t], key)) for t in (left, right)}
    seen = _streamed(runs[left]).withColumn("table_name", F.lit(left)).unionByName(_streamed(runs[right]).withColumn("table_name", F.lit(right)))
    a, b = (runs[t].where("k is not null").select("file", "k", "n") for t in (left, right))
    pairs = a.join(b.select("k", F.col("n").alias("m")), "k").groupBy("file").agg(F.sum(F.col("n") * F.col("m")).alias("n_joined"))
    pairs = pairs.join(F.broadcast(files.where(F.col("table_name") == left)), "file").select("bucket", "n_joined")
    came = lineage.groupBy("table_name", "bucket").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("xs"))
    came = came.select("table_name", "bucket", F.sha2(F.array_join(F.transform("xs", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["n"].cast("string"))), ","), 256).alias("lineage_sha256"))
    out = files.withColumn("columns", columns).join(seen, ["table_name", "file"]).join(came, ["table_name", "bucket"]).join(pairs, "bucket", "left")
    return out.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), "rewritten")
