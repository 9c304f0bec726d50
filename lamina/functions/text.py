"""Text functions as Column expressions: they stay in the JVM and are null for a null text unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

WORD = r"[\p{L}\p{N}_]{2,}"


def redact(text: Column) -> Column:
    """Every secret and every piece of personal data replaced by [REDACTED_<label>], pattern after pattern."""
    return reduce(lambda c, p: F.regexp_replace(c, f"(?i){p[0]}", f"[REDACTED_{p[1]}]"), V.SECRET_PATTERNS + V.PII_PATTERNS, text)


def matches_any(text: Column, patterns, ignore_case: bool = True) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(("(?i)" if ignore_case else "") + p) for p in patterns])


def has_secrets(text: Column) -> Column:
    return matches_any(text, [p for p, _ in V.SECRET_PATTERNS + V.PII_PATTERNS])


def pii_labels(text: Column) -> Column:
    """The labels of the personal data found, in their fixed order; case counts here."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in V.PII_PATTERNS]))


def holds_word(text: Column, words) -> Column:
    return holds_lowered(F.lower(text), words)


def holds_lowered(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words])


def is_secret(text: Column, never=V.NEVER_FORGET) -> Column:
    return holds_word(text, never) | has_secrets(text)


def synonym(word: Column) -> Column:
    return reduce(lambda c, kv: c.when(word == kv[0], F.lit(kv[1])), V.SYNONYMS.items(), F.when(F.lit(False), word)).otherwise(word)


def stem(word: Column) -> Column:
    """The first suffix rule that fits, if more than two letters would be left before it; one rule only."""
    cases = F.when(F.lit(False), word)
    for suffix, to in V.SUFFIXES:
        n = len(suffix)
        cases = cases.when(word.endswith(suffix) & (F.length(word) > n + 2), F.concat(word.substr(F.lit(1), F.length(word) - n), F.lit(to)))
    return cases.otherwise(word)


def words(text: Column) -> Column:
    """The words of two or more letters, digits or underscores, in lower case and in order, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*V.STOP_WORDS))


def stems(text: Column) -> Column:
    """array<string>: words, with synonyms, stemmed. Over many rows explode words() and use stemmed(), which stays in generated code."""
    return F.transform(F.transform(words(text), synonym), stem)


def words_in(df, text: Column, *keys: str):
    """(keys, word) of every word of a text, as words() gives them, a row each; stop words are left out in generated code."""
    every = F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")
    return df.select(*keys, every).where(~F.col("word").isin(*V.STOP_WORDS))


def stemmed(df, word: str, to: str):
    """df with the stem of a word in column `to`. In steps, the number of the rule that fits before its one cut: nested, or with a
    cut in each case, the generated method is too long for the JVM to compile and is interpreted."""
    w = F.col(to)
    rule = F.when(F.lit(False), F.lit(0))
    for i, (suffix, _) in enumerate(V.SUFFIXES, 1):
        rule = rule.when(w.endswith(suffix) & (F.length(w) > len(suffix) + 2), F.lit(i))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_rule"))
    cut = F.concat(w.substr(F.lit(1), F.length(w) - of(len(s) for s, _ in V.SUFFIXES)), of(s for _, s in V.SUFFIXES))
    return df.withColumn(to, synonym(F.col(word))).withColumn("_rule", rule).withColumn(to, F.when(F.col("_rule").isNull(), w).otherwise(cut)).drop("_rule")


def cluster(text: Column) -> Column:
    return cluster_lowered(F.lower(text))


def cluster_lowered(low: Column) -> Column:
    """The cluster of a text in lower case; as a column of its own it is lowered once, not once for each word."""
    return reduce(lambda c, g: c.when(holds_lowered(low, g[1]), F.lit(g[0])), V.CLUSTERS, F.when(F.lit(False), F.lit(""))).otherwise(F.lit("other"))


def cluster_title(group: Column) -> Column:
    return F.initcap(F.replace(group, F.lit("_"), F.lit(" ")))


def line_confidence(line: Column, confidence=None) -> Column:
    """The confidence of the first level with a marker in the line; 0 without one."""
    levels = V.CONFIDENCE | (confidence or {})
    return reduce(lambda c, m: c.when(matches_any(line, m[1]), F.lit(float(levels[m[0]]))), V.MARKERS, F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))


def strip(text: Column, chars: str = " \t\n\r\x0b\x0c") -> Column:
    return F.btrim(text, F.lit(chars))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def nearest_level(c: Column, levels=None) -> Column:
    """The level of confidence nearest to c; the first in order wins a tie."""
    order = sorted((levels or V.CONFIDENCE).values(), reverse=True)
    best = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("v"))
    return F.aggregate(F.array(*[F.lit(float(v)) for v in order]), best, lambda a, v: F.when(F.abs(v - c) < a.d, F.struct(F.abs(v - c).alias("d"), v.alias("v"))).otherwise(a), lambda a: a.v)


def parse_time(text: Column, otherwise: Column) -> Column:
    """A naive timestamp: an offset is cut off, not applied; what does not parse is `otherwise`."""
    cut = F.split(text, "[+Z]").getItem(0)
    tries = [F.expr("null")]
    for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"):
        tries.append(F.try_to_timestamp(cut, F.lit(p)).cast("timestamp_ntz"))
    return F.coalesce(*tries[1:], otherwise)


ACTIONS = (("consolidate", r"consolidate\s+(\w+)\s*[-]+>\s*(\w+)"), ("summarize", r"summarize\s+(\w+)\s*[-]+>\s*(\w+)"))


def parse_action(action: str) -> dict[str, str]:
    """{verb, from, to}, {verb: extract, to, condition?} or {verb: unknown, raw}, from a rule's text."""
    action = action.strip()
    for verb, pattern in ACTIONS:
        if m := re.match(pattern, action, re.I):
            return {"verb": verb, "from": m[1], "to": m[2]}
    if m := re.match(r"extract\s*-+>\s*(\w+)(?:\s+if\s+(.+))?", action, re.I):
        return {"verb": "extract", "to": m[1]} | ({"condition": m[2]} if m[2] else {})
    return {"verb": "unknown", "raw": action}
