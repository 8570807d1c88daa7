"""A training-data pipeline over documents: toxicity, language ID, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Every stage takes an empty table and gives an empty one, takes texts of any length whole, and lets columns of any name
pass, since its own take free names. This file needs the subpackage rasterloom.llm, and is of no use without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import common, langid, neardup, packing, repeats, toxicity

TOXIC = 0.5  # documents scored as high go
LANGUAGE = 0.3  # documents whose language scores less go: with four languages, none stands out


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the field, trained on the labelled ones, scores as toxic.

    A null or empty text has the score of no tokens. Rows of equal text go or stay together; ids play no part.
    """
    field = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    score = common.free_name(docs, "toxic_score")
    return toxicity.tag(docs, field, score=score, spans=None).where(F.col(score) < TOXIC).drop(score)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them) or of no discernible language. Rows of equal text go or stay together."""
    pred, score = common.free_name(docs, "lang_pred"), common.free_name(docs, "lang_score")
    told = langid.identify(docs, langid.fit(docs), pred=pred, score=score)
    return told.where((F.col(pred) != "und") & (F.col(score) >= LANGUAGE)).drop(pred, score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, that of least id (null comes last): five-word shingles, similarity 0.8 or more.

    Rows are told apart by a number of their own, so repeated rows and ids, and rows without an id, are members like others.
    Of equal rows one stays. A text without words, null or empty, is like no other and stays.
    """
    row, tie = common.free_name(docs, "row"), F.xxhash64(*docs.columns)
    rows = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    told = common.written(neardup.classes(rows, id=row, k=5, percent=80), "classes")
    several = told.join(told.where("not kept").select("component_id").distinct(), "component_id", "left_semi").select("component_id", F.col("doc_id").alias("row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), tie.alias("tie"), F.col(row).alias("row"))
    members = several.join(rows.select(order.alias("order")), F.col("row") == F.col("order.row")).select("component_id", "order")
    least = members.groupBy("component_id").agg(F.min("order").alias("least"))
    gone = members.join(least, "component_id").where("order.row != least.row").select(F.col("order.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of 200 and more that start elsewhere too. Characters cut in two become U+FFFD; a null text stays null.

    Rows of equal text lose all that they share; after the stage before, there are none. n_chars counts what is left.
    """
    was = common.free_name(docs, "was_null")
    marked = docs.withColumn(was, F.col("text").isNull())
    kept, removed = (common.free_name(marked.drop("text"), c) for c in ("kept", "n_removed"))
    left = repeats.remove(marked, length=200)
    text = F.when(~F.col(was), F.make_valid_utf8(F.col(kept).cast("string")))
    changed = left.withColumn("text", text).withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokenised texts into sequences of at most 1024 tokens. A null or empty text is its end id alone; repeated rows are packed each for itself."""
    return packing.pack_texts(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_text", repeated_text_stage),
    ("packing", packing_stage),
]

#: No SQL says what the trained stages do; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
