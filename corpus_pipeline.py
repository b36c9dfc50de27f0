"""The corpus pipeline: quality, line dedup, near dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from revlens.llm.common import Stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go.

    Null and empty texts are judged as texts without words, repeated rows alike, and rows without an id like others; without labels of both kinds
    all score the share of good ones (0.5 without any), so nothing is judged by a classifier that learned nothing. An empty table gives none. Columns
    other than those of documents are left out, here and in every stage.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    return quality.score_quality(docs, labels).where("score >= 0.3").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; a document may be left without text, and stays.

    A null or empty text has one empty line, which is kept, so null becomes empty. A repeated row counts as a document of its own. Empty
    tables give none.
    """
    out = line_dedup.dedup_lines(docs, min_docs=10)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; repeated rows count as copies.

    Shingles are five words, as for all stages without a contract of their own; op10's contract asks for four. Documents without words and those
    without an id are in no group and stay, a row each. An empty table gives none.
    """
    found = near_dedup.near_duplicates(docs, width=5, percent=80).where("stays").select("doc_id", "text_hash", "n_shingles").distinct()
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    grouped = keyed.join(found.where("n_shingles > 0 AND doc_id IS NOT NULL"), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    blank = keyed.join(found.where("n_shingles = 0 AND doc_id IS NOT NULL"), ["doc_id", "text_hash"], "left_semi")
    return grouped.unionByName(blank).unionByName(keyed.where("doc_id IS NULL")).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null, empty and wordless texts hold none, and without items none does. Repeated rows go together, an empty table gives none."""
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where(F.size("items") == 0).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of all documents that are left; what a document without words or id, or a null source, gets stands in mixing.mix(). An empty table gives none."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", leak_stage), ("mixing", mix_stage)]
#: A trained classifier isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = table(spark, sf_dir, "documents"), Stored(spark)
    for _, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir))
    return docs
