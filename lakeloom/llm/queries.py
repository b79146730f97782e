"""The registered queries of the training-data operators; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, html, lines, lm, mixing, negatives, packing, quality, search, secrets, simhash, urls
from .common import table
from .sql import OP2_SQL, OP3_SQL, OP4_SQL, OP6_SQL, OP10_SQL, OP11_SQL, OP12_SQL, OP13_SQL


#: The stated rules: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "share")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed_lines"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", moved.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("anchor"))
    return negatives.mine(rows, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_html": op1_html, "op2_quality": op2_quality, "op3_secrets": op3_secrets, "op4_lines": op4_lines, "op5_urls": op5_urls, "op6_mixing": op6_mixing, "op7_lm": op7_lm, "op8_simhash": op8_simhash, "op9_packing": op9_packing, "op10_embeddings": op10_embeddings, "op11_negatives": op11_negatives, "op12_decontamination": op12_decontamination, "op13_search": op13_search}
ORACLE_SQL = {"op2_quality": OP2_SQL, "op3_secrets": OP3_SQL, "op4_lines": OP4_SQL, "op6_mixing": OP6_SQL, "op10_embeddings": OP10_SQL, "op11_negatives": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_search": OP13_SQL}
