"""Stateful lanes around the streams: the last principals seen, retractions to retry, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def acl_lane(seen: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, seen after) for a batch (record, principals, at) against the last principals of each record."""
    last = batch.groupBy("record").agg(F.max_by("principals", "at").alias("current"))
    rows = last.join(seen.select("record", F.col("principals").alias("prior")), "record", "full_outer")
    changes = rows.where("current IS NOT NULL").select("record", F.array_sort(F.array_except(F.coalesce("prior", F.array().cast("array<string>")), "current")).alias("removed"), F.array_sort(F.array_except("current", F.coalesce("prior", F.array().cast("array<string>")))).alias("added"))
    return changes.where("size(removed) + size(added) > 0"), rows.select("record", F.coalesce("current", "prior").alias("principals"))


def retraction_ledger(parked: DataFrame, attempts: DataFrame) -> DataFrame:
    """Retirements still to be tried: parked (record) and those of attempts (record, ok) that never succeeded."""
    done = attempts.where("ok").select("record").distinct()
    return parked.select("record").unionByName(attempts.select("record")).distinct().join(done, "record", "left_anti")


def fenced(cursor_at: int | None, now: int, bound: int) -> bool:
    """Whether reads must fail closed: no cursor, or one that lags beyond the bound."""
    return cursor_at is None or now - cursor_at > bound
