"""Membership changes as a stream: gaps that degrade, and removals seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(changes: DataFrame) -> DataFrame:
    """Numbers after which changes (seq) are missing: each start of a run of numbers but the first.

    The number before each is looked up by an equi-join, so no order over all
    changes is made in one task.
    """
    seqs = changes.select("seq").distinct()
    before = seqs.select((F.col("seq") + 1).alias("seq"))
    first = seqs.agg(F.min("seq").alias("first"))
    return seqs.join(before, "seq", "left_anti").crossJoin(F.broadcast(first)).where("seq > first").select("seq")


def watched(changes: DataFrame, window: int) -> DataFrame:
    """Changes (seq, member, parent, at) with degraded, from the first missed change on until a resync, and fresh:
    not the same pair again within ``window`` of the one before."""
    own = Window.partitionBy("member", "parent").orderBy("seq")
    fresh = ~F.coalesce(F.col("at") - F.lag("at").over(own) < window, F.lit(False))
    latch = gaps(changes).agg(F.min("seq").alias("latched"))  # one row
    return changes.withColumn("fresh", fresh).crossJoin(F.broadcast(latch)).withColumn("degraded", F.coalesce(F.col("seq") >= F.col("latched"), F.lit(False))).drop("latched")
