"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, linededup, minhash, mixing, packing, pii, quality, sharding, vptree, warc
from .common import materialize, table
from .sql import ORACLES

#: Words a shingle of the near-duplicate query has; other stages take five.
QUERY_SHINGLE = 4


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text is gone before the draw, but not its hash, which tells documents of equal doc_id and size apart."""
    sized = mixing.with_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sized = materialize(sized.select("doc_id", "source", "_size", F.xxhash64("text").alias("_print")))
    taken = mixing.mix(sized)
    return taken.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"), "source")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(table(spark, sf_dir, "documents")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=QUERY_SHINGLE)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went, and the length and MD5 of the text that is left; the site is the source."""
    clean = linededup.drop_boilerplate_lines(table(spark, sf_dir, "documents"), F.col("source"))
    return clean.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for raw pages by the host of their URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))
    clean = linededup.drop_boilerplate_lines(pages, F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1)))
    return clean.select("page_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.md5("text").alias("text_md5"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("_p_text").alias("p_text"), F.col("_p_meta").alias("p_meta"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("kept"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_packing,
        op3_sharding,
        op4_mixing,
        op5_pii,
        op6_minhash_near_dedup,
        op7_line_dedup,
        line_dedup_pages,
        op8_nearest_neighbours,
        op9_quality_classifier,
        op10_warc_round_trip,
    )
}

__all__ = ["ORACLES", "QUERIES"]
