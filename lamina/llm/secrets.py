"""Secret scans with DataFrame functions only.

Base kinds are patterns: `assign`, `access` and `hex`, leftmost and non-overlapping per
kind. The method adds `entropy_hex` and `entropy_base64`: over candidate runs of 20 or more
characters of the class, a window slides; each step adds one character and removes one, which changes two counts and the sum of
c*log2(c) by four table look-ups, so a run costs time in proportion to its length. A run
is reported from the first to the last window whose Shannon entropy reaches the class's
threshold, unless the allow list suppresses the run or a base span contains it.

Positions are code points, end exclusive. A null or empty text has no spans. Every row is
scanned by itself: no shuffle, no Python; repeated rows are scanned again. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
WORDS = "password|passwd|secret|token|api_?key"
ASSIGN = f"((?i:{WORDS}))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# The runs below are maximal, so a lower bound on the length keeps just the matches that pass.
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
WINDOW = 20
CHUNK = 256
PIECE = 4096
#: Bits a character that a window must reach, by class.
THRESHOLD = {"entropy_hex": 3.0, "entropy_base64": 3.6}
#: A word, capitals or up to 8 digits, between separators or ends of the run.
WORD = "(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?![A-Za-z0-9])"
#: What words in camel case of two or more small letters don't have.
NOT_CAMEL = "[0-9]|[A-Z](?![a-z])|(?<![a-z])[a-z](?![a-z])"


def words(run: Column) -> Column:
    """Whether all that stands between separators is a word, capitals or a short number, as in paths and hyphenated names.

    Words are deleted and what is left is looked at: a pattern that repeats a group would recurse for each word, and a
    long run would overflow the stack.
    """
    return ~F.regexp_replace(run, WORD, "").rlike("[A-Za-z0-9]")


def camel(run: Column) -> Column:
    """Whether a run is of words in camel case."""
    return run.rlike("[a-z]") & ~run.rlike(NOT_CAMEL)


#: Runs that are public by their form, as patterns without repeated groups or as functions of the run: UUIDs, numbers with separators, paths and hyphenated words with a number, words in camel case.
ALLOW = ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "^[0-9+/_-]+$", words, camel)


def _found(text: Column, pattern: str, order: int, kind: str, keep=None) -> Column:
    """array<struct<start, ord, kind, end, hit>> of the matches of pattern; the work is done only where there is one."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    item = "struct<start:int,ord:int,kind:string,end:int,hit:string>"
    def step(acc, x):
        start = acc.at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        good = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"])
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc.out, one)).otherwise(acc.out).alias("out"))

    # Matches are taken CHUNK at a time, each chunk from where it starts in the text, so no long array is copied for every match.
    width = lambda acc, x: acc + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), F.size(zipped) - 1, F.lit(CHUNK)), lambda i: F.slice(zipped, i + 1, F.lit(CHUNK)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), width)), none, lambda acc, n: F.struct((acc.at + n).alias("at"), F.array_append(acc.out, acc.at).alias("out")), lambda acc: acc.out)
    part = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(f"array<{item}>").alias("out")), step, lambda acc: acc.out)
    got = F.flatten(F.zip_with(chunks, starts, part))
    return F.when(text.rlike(pattern), got).otherwise(F.array().cast(f"array<{item}>"))


def _windows(run: Column, window: int, threshold: Column) -> Column:
    """struct<first, last>: start and end, within the run, of the windows that reach the threshold; -1 if none does."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    init = F.struct(F.lit("").alias("seen"), F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), table.alias("f"))

    def step(acc, add):
        full = acc.i >= window
        gone = F.when(full, F.substring(acc.seen, 1, 1)).otherwise("")
        # The counts, within the last `window` characters, of the one that comes and the one that goes.
        count = lambda c: F.length(acc.seen) - F.length(F.replace(acc.seen, c, F.lit("")))
        ca, cg = count(add), count(gone)
        more = F.get(acc.f, ca + 1) - F.get(acc.f, ca)
        less = F.when(full, F.get(acc.f, cg - 1) - F.get(acc.f, cg)).otherwise(0.0)
        s = F.when(add == gone, acc.s).otherwise(acc.s + more + less)
        hit = (acc.i >= window - 1) & (F.lit(math.log2(window)) - s / window >= threshold - 1e-9)
        first = F.when(hit & (acc["first"] < 0), acc.i - (window - 1)).otherwise(acc["first"])
        seen = F.concat(F.when(full, F.substring(acc.seen, 2, window - 1)).otherwise(acc.seen), add)
        return F.struct(seen.alias("seen"), (acc.i + 1).alias("i"), s.alias("s"), first.alias("first"), F.when(hit, acc.i + 1).otherwise(acc["last"]).alias("last"), acc.f.alias("f"))

    return F.aggregate(run["chars"], init, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def spans(text: Column, allow: tuple[str | Callable[[Column], Column], ...] = ALLOW, window: int = WINDOW) -> tuple[Column, Column]:
    """(base, runs): arrays of struct<start, ord, kind, end, hit>, not sorted; runs are the candidates of the entropy kinds."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(
        _found(text, ASSIGN, 0, "assign", lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6),
        _found(text, ACCESS, 1, "access"),
        _found(text, HEX, 2, "hex"),
    )
    public = lambda h: ~_any([h.rlike(p) if isinstance(p, str) else p(h) for p in allow]) if allow else F.lit(True)
    return base, _found(text, RUN, 3, "run", public)


def _chunks(spans: Column) -> Column:
    """An array of arrays of CHUNK spans, in order; none for an empty one."""
    starts = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.size(spans) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(spans, i + 1, F.lit(CHUNK)))


def _free(runs: Column, base: Column) -> Column:
    """The runs that no base span contains. CHUNK runs at a time meet the base spans of their stretch of the text, not all of them."""

    def part(c):
        low, high = c[0]["start"], F.get(c, F.size(c) - 1)["end"]
        near = F.filter(base, lambda b: (b["start"] < high) & (b["end"] > low))
        return F.struct(c.alias("runs"), near.alias("near"))

    met = F.transform(_chunks(runs), part)
    return F.flatten(F.transform(met, lambda m: F.filter(m["runs"], lambda r: ~F.exists(m["near"], lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def scan(docs: DataFrame, text: str = "text", allow: tuple[str | Callable[[Column], Column], ...] = ALLOW, window: int = WINDOW) -> DataFrame:
    """Every row with `base` and `found`: arrays of struct<start int, ord int, kind string, end int>, sorted by start, then kind.

    base has the pattern kinds only; found has all kinds. Columns of these names are replaced.
    """
    base, runs = spans(F.col(text), allow, window)
    item = "array<struct<start:int,ord:int,kind:string,end:int>>"
    df = docs.drop("base", "found", "_runs").withColumns({"base": base, "_runs": runs})
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))
    df = df.withColumn("_runs", F.when(F.size("_runs") > 0, _free(F.col("_runs"), F.col("base"))))
    chars = F.transform("_runs", lambda r: F.struct(r["start"].alias("start"), F.split(r["hit"], "").alias("chars"), r["hit"].rlike("^[0-9a-fA-F]+$").alias("hex")))
    df = df.withColumn("_runs", chars)
    limit = lambda r: F.when(r["hex"], THRESHOLD["entropy_hex"]).otherwise(THRESHOLD["entropy_base64"])
    seen = F.transform("_runs", lambda r: F.struct(r["start"].alias("start"), r["hex"].alias("hex"), _windows(r, window, limit(r)).alias("w")))
    named = F.transform(
        F.filter(seen, lambda r: r["w"]["first"] >= 0),
        lambda r: F.struct(
            (r["start"] + r["w"]["first"]).alias("start"), F.when(r["hex"], 3).otherwise(4).alias("ord"),
            F.when(r["hex"], "entropy_hex").otherwise("entropy_base64").alias("kind"), (r["start"] + r["w"]["last"]).alias("end"),
        ),
    )
    return df.withColumns({"found": F.array_sort(F.concat(plain.cast(item), F.coalesce(named.cast(item), F.array().cast(item)))), "base": F.array_sort(plain)}).drop("_runs")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, **kw) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), **kw)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def mask(docs: DataFrame, text: str = "text", label: str = "[SECRET]", **kw) -> DataFrame:
    """Every row with each stretch that spans cover replaced by label, where spans that overlap or touch count as one. Nothing else changes."""
    own = unused(docs, "_cover")
    found = scan(docs, text, **kw)
    # Spans that overlap or touch make one stretch; they come sorted by start, so the furthest end so far tells where one ends.
    none = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def merge(acc, x):
        one = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))
        longer = F.array(F.struct(F.element_at(acc.out, -1)["start"].alias("start"), F.greatest(acc["end"], x["end"]).alias("end")))
        fresh = x["start"] > acc["end"]
        out = F.when(fresh, F.concat(acc.out, one)).when(x["end"] > acc["end"], F.concat(F.slice(acc.out, F.lit(1), F.size(acc.out) - 1), longer)).otherwise(acc.out)
        return F.struct(F.greatest(acc["end"], x["end"]).alias("end"), out.alias("out"))

    # Stretches are made CHUNK spans at a time, so no long array is copied for every span; stretches of neighbouring chunks that meet are one.
    parts = F.transform(_chunks(F.col("found")), lambda c: F.aggregate(c, none, merge, lambda acc: acc.out))
    found = found.withColumn(own, F.when(F.size("found") > 0, F.flatten(parts)))
    # The text is taken in pieces; each stretch is replaced in the piece where it starts and left out of the others.
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def piece(p, k):
        low, high = k * PIECE, k * PIECE + F.length(p)
        near = F.filter(F.col(own), lambda x: (x["start"] < high) & (x["end"] >= low))
        init = F.struct(low.alias("at"), F.lit(-1).alias("end"), F.lit("").alias("out"))

        def step(acc, x):
            begins = (x["start"] >= low) & (x["start"] > acc["end"])
            gap = F.when(x["start"] > acc.at, F.substring(p, acc.at - low + 1, x["start"] - acc.at)).otherwise("")
            return F.struct(F.greatest(acc.at, x["end"]).alias("at"), F.greatest(acc["end"], x["end"]).alias("end"), F.concat(acc.out, gap, F.when(begins, label).otherwise("")).alias("out"))

        rest = lambda acc: F.concat(acc.out, F.when(acc.at < high, F.substring(p, acc.at - low + 1, high - acc.at)).otherwise(""))
        return F.aggregate(near, init, step, rest)

    masked = F.array_join(F.transform(pieces, piece), "")
    return found.withColumn(text, F.when(F.col(own).isNotNull(), masked).otherwise(F.col(text))).select(docs.columns)
