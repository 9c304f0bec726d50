"""A corpus pipeline: language ID, near duplicates, secrets, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame. All but the last return the columns of documents.

Every stage takes nulls in any column, empty and long texts, repeated rows and empty tables: a null
text or one without letters is in no known language and goes with the first stage; repeated rows
are one group of near duplicates, of which one row stays; rows with a null id stay as they
are; a null source is a source of its own; a null text has no tokens. No rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, jaccard, langid, mixing, secrets
from lamina.llm.common import shared_dir, table
from lamina.llm.queries import vocabulary


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough stay, with that language as lang; nothing is learned from the held-out fifth."""
    learned = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, learned)
    return got.where("not rejected").select([F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, directly or by links, the one with the smallest id stays."""
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked, and n_chars follows the text."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mixing.mix(docs, max_repeats=2.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): the token ids of every document, and the digest of the bytes they decode to."""
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, keep=["doc_id", "lang", "source"], digest=True, keep_ids=True)


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mixture),
    ("byte-level BPE", encoding),
]

#: SQL can't express the compression classifier or the encoding; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written to the shared folder and read again.

    A stage's input is removed when its output is written; the last stage's stays, as the result is read from it.
    """
    docs, to = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{to}/{k}")
            out = spark.read.parquet(f"{to}/{k}")
            if k:
                _remove(spark, f"{to}/{k - 1}")
        docs = out
    return docs
