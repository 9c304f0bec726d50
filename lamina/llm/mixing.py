"""Mixing sources to target weights, with DataFrame functions only.

Method: temperature mixing. The weight of a source is its share of the tokens to the power
alpha, normalised. alpha is bisected on a grid of 1/4096 between 0 (equal weights) and 1
(natural shares): the largest at which the entropy of the weights reaches a target, or the
smallest at which no source is repeated more often than max_repeats. The budget, in
tokens, is dealt by weight; without one it is the least budget at which every source is
seen whole at least once. A source's quota is realised as whole epochs and part of one.
Every epoch is a permutation by seeded hashes, cut into blocks of about block_tokens; the
part takes blocks in order, and rows in order within the last one, while they fit.

Row work is a scan and joins with one row per source. Running sums go over blocks, then
over the rows of one block, so a source with a third of all rows is no single task's work.

A row counts its words (runs of other than ASCII white space) and one end mark, so empty
and null texts count 1. A null source is a source of its own. Repeated rows are drawn by
themselves, together where their keys are equal; rows with equal hashes are taken or left
together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, unused

GRID = 4096
SPAN = 1 << 48
WORD = "[^\\x20\\x09-\\x0D]+"


def n_tokens(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def place(key: Column, epoch: Column, seed: int) -> Column:
    """Where a row stands in an epoch's permutation: 0 to 2^48 - 1, from an MD5 digest."""
    said = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 12), 16, 10).cast("long")


def bisect(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None, ways: int = 16) -> float:
    """alpha. Each round tries `ways` - 1 inner points of the interval with one aggregate over the sources."""
    stats = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("top")).first()
    if not stats.t:
        return 1.0
    share = F.col("tokens") / F.lit(float(stats.t))
    # A property of alpha that holds on a lower part (entropy) or an upper part (repeats) of the grid.
    low, high = 0, GRID
    while True:
        points = sorted({low + (high - low) * k // ways for k in range(ways + 1)})
        sums = []
        for k in points:
            p = F.pow(share, F.lit(k / GRID))
            sums += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log(p)).alias(f"h{k}"), F.max(p / F.col("tokens")).alias(f"m{k}"), F.max(F.col("tokens") / p).alias(f"b{k}")]
        r = totals.agg(*sums).first().asDict()

        def holds(k, r=r):
            import math

            z = r[f"z{k}"]
            if target_entropy is not None:
                return math.log(z) - r[f"h{k}"] / z >= target_entropy - 1e-9
            most = r[f"m{k}"] * (r[f"b{k}"] if budget is None else budget / z)
            return most <= max_repeats + 1e-9

        good = [k for k in points if holds(k)]
        if target_entropy is not None:  # the largest that holds; 0 if none does
            at = max(good, default=0)
            low, high = at, min([k for k in points if k > at], default=at)
        else:  # the smallest that holds; 1 if none does
            at = min(good, default=GRID)
            low, high = max([k for k in points if k < at], default=at), at
        if high - low <= 1:
            return at / GRID


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None, seed: int = 17, block_tokens: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(rows, sources). rows: key, source, n_tokens of every input row. sources, one row each: tokens, weight, repeats
    (planned epochs), epochs (whole ones), stop (places below it are in the last, partial epoch) and blocks."""
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_tokens(F.col(text)).alias("n_tokens")))
    totals = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    alpha = bisect(totals, target_entropy, max_repeats, budget)
    t = float(totals.agg(F.sum("tokens")).first()[0] or 1)
    power = totals.withColumn("p", F.pow(F.col("tokens") / t, F.lit(alpha)))
    z, b = power.agg(F.sum("p"), F.max(F.col("tokens") / F.col("p"))).first()
    dealt = float(budget) / z if budget is not None and z else b or 0.0
    repeats = F.round(F.col("p") * F.lit(float(dealt)) / F.col("tokens"), 9)
    sources = power.select(
        "source", "tokens", (F.col("p") / F.lit(float(z or 1))).alias("weight"), repeats.alias("repeats"), F.floor(repeats).cast("int").alias("epochs"),
        F.floor((repeats - F.floor(repeats)) * F.col("tokens") + 1e-6).cast("long").alias("rest"), F.ceil(F.col("tokens") / block_tokens).cast("int").alias("blocks"),
    )
    sources = cut(sources)
    # The partial epoch: whole blocks by running sums of block totals, then rows of the block where the budget ends.
    small = _hint(sources.withColumnRenamed("source", "_source"))
    part = rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).where("rest > 0").select("source", "n_tokens", "rest", "blocks", place(F.col("key"), F.col("epochs"), seed).alias("place"))
    part = part.withColumn("block", block_of(F.col("place"), F.col("blocks")))
    sums = part.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    # Over groups of blocks first, then over the blocks of the group where the budget ends: no sum runs over all blocks of a source.
    sums = sums.withColumn("group", F.floor(F.col("block") / 4096))
    groups = sums.groupBy("source", "group").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    near = _edge(groups, ["source"], "group").withColumnsRenamed({"source": "_source", "group": "_group"})
    blocks = sums.drop("rest").join(_hint(near), F.col("source").eqNullSafe(F.col("_source")) & (F.col("group") == F.col("_group"))).withColumnRenamed("left", "rest")
    edge = cut(_edge(blocks, ["source", "group"], "block").select("source", "block", "left"))
    ends = _hint(edge.withColumnsRenamed({"source": "_source", "block": "_block"}))
    inside = part.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).select("source", "block", "place", "n_tokens", "left")
    over = inside.withColumn("upto", F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow))).where("upto > left")
    stop = over.groupBy("source").agg(F.min("place").alias("stop"))
    out = sources.join(stop.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    # Without an edge block all of the epoch fits.
    return rows, cut(out.withColumn("stop", F.when(F.col("rest") == 0, 0).otherwise(F.coalesce("stop", F.lit(SPAN))).cast("long")))


def _edge(sums: DataFrame, within: list[str], by: str) -> DataFrame:
    """(within, by, left): where a running sum of n passes rest, and what of rest is left before it."""
    run = sums.withColumn("upto", F.sum("n").over(W.partitionBy(*within).orderBy(by)))
    return run.where("upto > rest and upto - n <= rest").select(*within, *([] if by in within else [by]), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))


def block_of(place: Column, blocks: Column) -> Column:
    """The block, of equal shares of an epoch's places. In double precision: exact enough, and alike everywhere."""
    return F.least(F.floor(place.cast("double") * blocks / F.lit(float(SPAN))).cast("int"), blocks - 1)


def _hint(small: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast only a table of a checked size; a larger one is left to a shuffled join, whose hot keys Spark splits."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def schedule(docs: DataFrame, **kw) -> DataFrame:
    """(key, source, n_tokens, epoch, block, rank, weight) of every drawn row: rank from 0 within (source, epoch, block)."""
    rows, sources = plan(docs, **kw)
    seed = kw.get("seed", 17)
    s = _hint(sources.withColumnRenamed("source", "_source"))
    drawn = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).select("key", "source", "n_tokens", "weight", "epochs", "stop", "blocks")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), "epochs"))).withColumn("place", place(F.col("key"), F.col("epoch"), seed))
    drawn = drawn.where((F.col("epoch") < F.col("epochs")) | (F.col("place") < F.col("stop"))).withColumn("block", block_of(F.col("place"), F.col("blocks")))
    rank = F.row_number().over(W.partitionBy("source", "epoch", "block").orderBy("place", "key", "n_tokens")) - 1
    return drawn.select("key", "source", "n_tokens", "epoch", "block", rank.alias("rank"), "weight")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", **kw) -> DataFrame:
    """The rows of docs, each as often as it is drawn, with the columns of docs, whatever their names. A scan and a join
    with one row per source."""
    _, sources = plan(docs, key=key, source=source, **kw)
    own = {c: unused(docs, f"_{c}") for c in ("source", "epochs", "stop", "n", "k")}
    s = _hint(sources.select(*[F.col(c).alias(own[c]) for c in ("source", "epochs", "stop")]))
    drawn = docs.join(s, F.col(source).eqNullSafe(F.col(own["source"])))
    last = (place(F.col(key), F.col(own["epochs"]), kw.get("seed", 17)) < F.col(own["stop"])).cast("int")
    times = F.when(F.col(own["n"]) > 0, F.sequence(F.lit(1), own["n"]))
    return drawn.withColumn(own["n"], F.col(own["epochs"]) + last).withColumn(own["k"], F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])
