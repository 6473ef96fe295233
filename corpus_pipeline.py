"""From raw documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import quality
from tallyweave.llm.common import free_name, stage, table
from tallyweave.llm.minhash import near_documents
from tallyweave.llm.packing import pack
from tallyweave.llm.suffix_dedup import without_repeats


#: Hundredths of Jaccard similarity from which documents are near-duplicates.
NEAR = 85


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled ones that are not held out.

    Each row is judged by its own text: repeated rows share a fate, null and empty texts are scored like others. Columns of
    any name stay as they are; an empty table stays empty."""
    model = quality.fit(quality.document_statistics(docs), table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "quality_score")
    return model.transform(docs, score_col=score).where(F.col(score) >= quality.ACCEPT).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows one: that of least id, null ids last, whatever other rows of its id hold.

    Null and blank texts are nobody's copies and stay. Columns of any name stay as they are."""
    row = free_name(docs.columns, "near_dedup_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_documents(rows, id_col=row, percent=NEAR).select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.col(row).alias("row"))
    first = rows.select(F.col(row).alias("row"), order.alias("order")).join(groups.hint("merge"), "row").groupBy("of").agg(F.min("order").alias("order"))
    return rows.join(first.select(F.col("order.row").alias(row)).hint("merge"), row, "left_semi").select(docs.columns)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur twice; n_chars follows the text.

    Null texts stay null; a text of which nothing is left stays as an empty one; a null n_chars stays null, and a table without
    that column gets none. Other columns of any name stay as they are."""
    if "n_chars" not in docs.columns:
        return without_repeats(docs)
    n = F.when(F.col("n_chars").isNotNull(), F.char_length(F.coalesce("text", F.lit("")))).cast("long")
    return without_repeats(docs).withColumn("n_chars", n).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, in the columns of op7. A null text counts as empty, which is one end mark; rows of one id are
    documents of their own."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", repeats_removed),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
