"""The queries of this package for __spark_entry__.py: thin wrappers that apply the operators to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, cobucket, crosspoly, html, jaccard, katz, langid, mixing, secrets, sharding, tokencount, topk
from .common import shared_dir, table
from .sql import SQL  # noqa: F401


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), learned)
    return got.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mixing.schedule(table(spark, sf_dir, "documents"))
    return s.select(F.col("key").alias("doc_id"), "source", "n_tokens", "epoch", "block", "rank", F.round("weight", 9).alias("weight"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), ~katz.held_out())


def op12_co_bucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, n = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), 300
    root = f"{shared_dir(spark)}/pair-{uuid.uuid4().hex}"
    b = F.coalesce(cobucket.bucket("sale_id", n, "line"), F.lit(n + 1))
    first = cobucket.lay_out(sales, F.when(b % 3 == 1, b - 1).otherwise(b), n + 2, "sale_id", f"{root}/sales")
    second = cobucket.lay_out(lines, F.coalesce(cobucket.bucket("item_id", n), F.lit(0)), n, "sale_id", f"{root}/sale_lines")
    schemas = {"sales": sales.schema, "sale_lines": lines.schema}
    lineage, finals = cobucket.co_bucket(spark, root, "sales", "sale_lines", first, second, schemas, "sale_id", n, "line")
    return cobucket.digest(spark, finals, lineage, schemas, "sales", "sale_lines", "sale_id")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_secret_scan, op3_source_mixing, op4_sharding, op5_token_counts, op6_ngram_jaccard, op7_exact_topk, op8_byte_bpe, op9_html_text, op10_embedding_dedup,
        op11_katz_scores, op12_co_bucketed_pair, op13_centroid_clusters,
    )
}
