"""Aggregates of the access graph and the resolution of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus(chunks: DataFrame, tenant: str) -> DataFrame:
    """Rows and distinct documents in all, by source and by class, in one pass over the grouping sets."""
    rows = chunks.where(F.col("tenant") == tenant).select("source", "confidentiality", F.struct("source", "document_id").alias("doc"))
    sets = rows.groupingSets([[], ["source"], ["confidentiality"]], "source", "confidentiality").agg(F.count("*").alias("n_rows"), F.count_distinct("doc").alias("n_documents"), F.grouping_id("source", "confidentiality").alias("g"))
    lane = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "source").otherwise("confidentiality")
    return sets.select(lane.alias("lane"), F.coalesce("source", F.col("confidentiality").cast("string"), F.lit("")).alias("key"), "n_rows", "n_documents")


def grant_confidence(chunks: DataFrame, tenant: str) -> DataFrame:
    """Per source, each label's share of the rows."""
    by = chunks.where(F.col("tenant") == tenant).groupBy("source", "label").agg(F.count("*").alias("n"))
    total = by.groupBy("source").agg(F.sum("n").alias("total"))
    return by.join(total, "source").select("source", "label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def documents_page(chunks: DataFrame, tenant: str, limit: int, after: tuple[int, int] | None = None) -> DataFrame:
    """Documents of a keyset page of chunks, newest first: least class, newest version, chunks, where first seen."""
    rows = chunks.where((F.col("tenant") == tenant) & F.col("valid_to").isNull()).select("source", "document_id", "confidentiality", "valid_from", "id")
    if after is not None:
        rows = rows.where(F.struct("valid_from", "id") < F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]).cast("long")))
    top = rows.orderBy(F.desc("valid_from"), F.desc("id")).limit(limit)
    return top.groupBy("source", "document_id").agg(F.min("confidentiality").alias("confidentiality"), F.max("valid_from").alias("valid_from"), F.count("*").alias("n_chunks"), F.max(F.struct("valid_from", "id")).getField("id").alias("first_seen"))


def object_tokens(chunks: DataFrame, tenant: str) -> DataFrame:
    """Per document, the distinct tokens that may see any chunk of it, and its least class."""
    rows = chunks.where(F.col("tenant") == tenant)
    tokens = rows.select("source", "document_id", F.explode("visibility").alias("token")).distinct().groupBy("source", "document_id").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("tokens"))
    least = rows.groupBy("source", "document_id").agg(F.min("confidentiality").alias("confidentiality"))
    return least.join(tokens, ["source", "document_id"], "left")


def resolve_local(links: DataFrame, canonical: DataFrame) -> DataFrame:
    """(source, local_id) to its canonical principal, where both sides are active."""
    return links.where("active").drop("active").join(canonical.where("active").select("canonical"), "canonical").select("source", "local_id", "canonical")


def resolve_subject(subjects: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """A sign-in subject to its canonical principal, directly or by an alias; null if neither is active."""
    own = canonical.where("active").select(F.col("canonical").alias("direct"), F.col("idp_subject").alias("subject"))
    via = aliases.join(canonical.where("active").select("canonical"), "canonical").select(F.col("alias").alias("subject"), F.col("canonical").alias("indirect"))
    return subjects.join(own, "subject", "left").join(via, "subject", "left").select("subject", F.coalesce("direct", "indirect").alias("canonical"))


def unresolved_tokens(chunks: DataFrame, principals: DataFrame) -> DataFrame:
    """Tokens in visibilities that no principal has."""
    return chunks.select(F.explode("visibility").alias("token")).distinct().join(principals, "token", "left_anti")


def fsck(chunks: DataFrame, facts: DataFrame, principals: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Integrity findings with a severity; a check without findings gives no row."""
    counts = [
        ("class_out_of_range", "error", chunks.where(~F.col("confidentiality").between(0, 3) | F.col("confidentiality").isNull())),
        ("chunk_interval_inverted", "error", chunks.where(F.col("valid_to") < F.col("valid_from"))),
        ("fact_interval_inverted", "error", facts.where(F.col("valid_to") < F.col("valid_from"))),
        ("visibility_empty", "warning", chunks.where((F.size("visibility") == 0) & F.col("valid_to").isNull())),
        ("unresolved_tokens", "warning", unresolved_tokens(chunks, principals)),
        ("quarantine_open", "info", quarantine.where(F.col("resolved_at").isNull())),
    ]
    out = None
    for name, severity, df in counts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n")
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")
