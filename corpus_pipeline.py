"""The corpus pipeline: classify, drop frequent lines, thin near copies, decontaminate, pack.

Each stage takes all documents that the one before kept, as written, and all
but the last return the columns of ``documents``. A stage that changes a text
counts its characters anew.

Cases: null and empty texts are documents like any other (the classifier scores
them; all that it keeps are one group of copies, of which one stays); very long
texts are read whole in every stage; rows that repeat id and text leave one row,
rows that repeat an id with another text are documents of their own; a null
doc_id is one, and stays if no copy with an id does; null lang, source or n_chars
pass through; a table without rows gives none; other columns, whatever their
names, are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_cnn, decontaminate, line_dedup, packing, simhash
from quarry.llm.common import discard_since, marked, saved
from quarry.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRY = ("lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    network = byte_cnn.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = byte_cnn.scored(docs, network, CARRY)
    return scored.where(F.col("score") >= 0.5).select("doc_id", "text", "carried.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; those left without text go."""
    rows = line_dedup.drop_lines(docs, carry=CARRY)
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.where(~empty).select("doc_id", "text", "carried.lang", "carried.source", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"))


def thin_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))  # never null, so texts are dealt once for the join and for equal rows
    groups = simhash.near_copies(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("key"))
    kept = docs.withColumn("key", key).join(first, "key", "left_semi")
    return kept.dropDuplicates(["key", "text"]).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    rows = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), carry=CARRY)
    return rows.select("doc_id", "text", "carried.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they stand in sequences of 2048 ids."""
    return packing.packed_documents(docs)


STAGES = [("quality classifier", classify), ("line dedup", drop_lines), ("near-dedup", thin_copies), ("decontamination", clean), ("best-fit packing", pack)]

#: SQL expresses neither the classifier nor the packing; tests/llm/test_pipeline.py holds every stage and the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        mark = marked() - bool(k)  # from the second stage on, the documents of the one before go as well
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
            discard_since(mark)
    return docs
