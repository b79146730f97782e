"""A corpus pipeline over `documents`: filter, deduplicate, mix, pack.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and
returns the next stage's documents, which are written as Parquet and read
again. All but the last keep the columns of `documents`. An empty table gives
an empty result at every stage; further columns pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import jaccard, lines, mixing, packing, quality
from lakeloom.llm.common import materialize, release
from lakeloom.sources.scratch import scope

#: What names a document: its id (null: 0 and a mark) and the hash of its text.
KEY = ["id", "unnamed", "hash"]


def _key(doc_id, text_hash) -> list:
    return [F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), doc_id.isNull().alias("unnamed"), text_hash.alias("hash")]


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows in a struct beside their key: no column of `docs` can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(F.col("doc_id"), F.xxhash64("text")))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the threshold table go; null and empty texts fail, repeated rows are judged alike."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents of which nothing is left.

    A null or empty text stays; rows that repeat id and text are one document and get the same text.
    """
    out = lines.dedup_lines(docs)
    left = (F.size("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(left).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word Jaccard similarity of 0.8 or more the one of the smallest id stays.

    Null and empty texts are copies of each other; rows that repeat id and text are one document.
    """
    found = jaccard.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = found.select(*_key(F.col("doc_id"), F.col("text_hash"))).distinct()
    return _unpacked(_rows(docs).join(found, KEY, "left_semi").dropDuplicates(KEY), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it, each source as near to its target as whole documents get.

    Null and empty texts are never used.
    """
    plan = mixing.mix(docs, tolerance=0).where("repeats > 0").select(*_key(F.col("doc_id"), F.col("text_hash")), "repeats").dropDuplicates(KEY)
    used = _rows(docs).join(plan, KEY)
    return _unpacked(used.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("repeats")))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null or empty text is the end token alone."""
    import public_tokenizers

    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Near-duplicates and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scope() as tables:
            docs = materialize(stage(spark, docs, sf_dir))
            # All that the stage wrote on its way goes, its result stays.
            tables[:] = [t for t in tables if t is not docs]
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
