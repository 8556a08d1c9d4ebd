"""A training corpus from raw documents in five stages, each an operator of ``strandwise.llm``.

Quality classifier (documents that it rejects go), line dedup by source, MinHash near-dedup (one
document of each group stays), mixing sources to target weights (documents are repeated or left out
as drawn), packing. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import linededup, minhash, mixing, packing, quality
from strandwise.llm.common import discard, materialize, scratch_scope, set_apart, table

KEEP_SCORE = 0.5
READ = ("doc_id", "text", "lang", "source", "n_chars")
#: Columns that the stages add for a while; columns of documents with such names are kept apart and come back.
ADDED = ("_p_text", "_p_meta", "_score", "_lines", "_dropped", "_row", "_copy_of", "_size", "source_size", "target", "_copies", "_copy")


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    return set_apart(docs, READ, ADDED, ())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores KEEP_SCORE or more, with the columns of documents.

    The classifier learns from ``labels`` and all of docs. Null, empty and wordless texts score 0 and go, whatever their
    other columns; nulls elsewhere are values like others. Repeated rows score alike, so stay or go together. A score of
    exactly KEEP_SCORE stays, so if there are too few labels to learn from, every document with words stays. Long texts are
    scored whole. An empty table gives an empty one.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    docs, columns = _apart(docs)
    return quality.score(docs, model).where(F.col("_score") >= KEEP_SCORE).select(*columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that are boilerplate within their source; n_chars is counted anew where lines went.

    Null sources are a source of their own; a null text stays null. No row goes, so repeated rows stay and are cleaned alike; a
    text may become empty. Long texts are cleaned whole. An empty table gives an empty one.
    """
    docs, columns = _apart(docs)
    clean = linededup.drop_boilerplate_lines(docs, F.col("source"))
    return clean.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id (nulls last), and of several rows of it one.

    Groups are found among rows, so rows that repeat a doc_id or have none are told apart, and copies among them go as well.
    Null, empty and wordless texts are near nothing and stay. Long texts are compared whole. An empty table gives an empty one.
    """
    docs, columns = _apart(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).groupBy("_id").count()
    kept: list[DataFrame] = []
    with scratch_scope(keep=kept):
        if ids.where("_id is null or count > 1").isEmpty():
            rows, gone = docs.withColumn("_row", F.col("doc_id").cast("long")), _copies(docs)
        else:
            # rows are numbered once and written, so that every later read knows them by the same number
            rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
            kept.append(rows)
            gone = _copies_among_rows(rows)
        kept.append(materialize(gone))
    return rows.join(kept[-1], F.col("_row") == F.col("_copy_of"), "left_anti").select(*columns)


def _copies(docs: DataFrame) -> DataFrame:
    """The ids of documents that aren't the smallest of their group."""
    return minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_copy_of"))


def _copies_among_rows(rows: DataFrame) -> DataFrame:
    """The same of rows with numbers: of a group the row of smallest doc_id stays, of several the first."""
    keyed = rows.select(F.col("_row").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("_id"))
    found = materialize(minhash.near_duplicates(keyed, carry=("_id",)).select(F.col("doc_id").alias("_row"), "_id", F.col("component_id").alias("_group")))
    best = F.min_by("_row", F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_stays")
    groups = found.groupBy(F.col("_group").alias("_g")).agg(F.count("*").alias("_n"), best).where("_n > 1")
    return found.join(groups, F.col("_group") == F.col("_g")).where("_row <> _stays").select(F.col("_row").alias("_copy_of"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated one after the other, or left out.

    Null sources are a source of their own; null and empty texts have no words, so cost a source nothing. Rows that repeat are
    drawn each. Long texts stay whole. The draw depends on the rows alone. An empty table gives an empty one.
    """
    docs, columns = _apart(docs)
    mixed = mixing.mix(mixing.with_sizes(docs)).where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens along the curve, a row for each piece of a document (see packing.pack).

    A null text is empty and is its end id alone; rows that repeat are packed each, and not side by side; long texts are cut
    over several sequences. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models, random draws and tokens are beyond SQL; tests/llm/test_pipeline.py follows the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's scratch tables go when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch_scope(keep=kept):
            kept.append(materialize(stage(spark, docs, sf_dir)))
        if hasattr(docs, "_scratch_path"):
            discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
