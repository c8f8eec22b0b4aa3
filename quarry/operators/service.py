"""Operational aggregates: freshness, backfills, settings, coverage, work queue, evaluation, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def freshness(samples: DataFrame, now: int, window: int) -> DataFrame:
    """Percentiles of the delay from event to being queryable, by source, over a window of queryable_at."""
    rows = samples.where((F.col("queryable_at") > now - window) & (F.col("queryable_at") <= now)).withColumn("lag", (F.col("queryable_at") - F.col("event_at")).cast("double"))
    cut = lambda p: F.round(F.percentile("lag", p), 3)  # noqa: E731  percentile interpolates, as percentile_cont
    return rows.groupBy("source").agg(F.count("*").alias("n"), cut(0.5).alias("p50"), cut(0.95).alias("p95"), cut(0.99).alias("p99"))


def backfill_progress(updates: DataFrame) -> DataFrame:
    """Runs from their updates (run, at, source, state, total, delta): counters add up, the rest is the last that was set."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return updates.groupBy("run").agg(last("source"), last("state"), last("total"), F.sum("delta").alias("processed"), F.max("at").alias("updated_at"))


def latest_per_source(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(F.max_by(F.struct("run", "state", "processed", "updated_at"), F.struct("updated_at", "run")).alias("r")).select("source", "r.*")


def settings(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """Each tenant's value of each name that exists: its own, else the one for all (tenant null).

    Values for all are few names; each goes to every tenant, so they are the
    side that is sent: one row for each default and tenant, and one for each own value.
    """
    own = rows.where("tenant IS NOT NULL").select("tenant", "name", F.col("value").alias("own"))
    base = rows.where("tenant IS NULL").groupBy("name").agg(F.first("value").alias("base"))
    given = base.withColumn("everyone", F.lit(1)).join(tenants.select("tenant").withColumn("everyone", F.lit(1)), "everyone").select("tenant", "name", "base")
    return own.join(tenants.select("tenant"), "tenant", "left_semi").join(given, ["tenant", "name"], "full_outer").select("tenant", "name", F.coalesce("own", "base").alias("value"))


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per source how many current chunks have a vector."""
    rows = chunks.where("valid_to IS NULL").join(vectors.select("id", F.lit(True).alias("has")), "id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("has")).alias("embedded"), F.count_if(F.col("has").isNull()).alias("missing"))


def lease(episodes: DataFrame, leases: DataFrame, done: DataFrame, now: int, limit: int) -> DataFrame:
    """Episodes to work on: of the kinds that are consolidated, not done, with no lease that still runs."""
    rows = episodes.where(F.col("kind").isin("observation", "webhook", "doc_version")).join(done.select("episode_id"), "episode_id", "left_anti")
    held = leases.groupBy("episode_id").agg(F.max("leased_until").alias("leased_until"))
    return rows.join(held, "episode_id", "left").where(F.col("leased_until").isNull() | (F.col("leased_until") <= now)).orderBy("recorded_at", "episode_id").limit(limit).select("episode_id", "kind", "recorded_at")


def complete(done: DataFrame, leases: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """What becomes of reports (episode_id, worker, at) of finished work: completed once, a repeat, or without a lease that runs.

    done: episode_id; leases: episode_id, worker, leased_until. The first report
    of an episode under its own running lease completes it; later ones change nothing.
    """
    held = leases.groupBy("episode_id", "worker").agg(F.max("leased_until").alias("leased_until"))
    rows = reports.join(held, ["episode_id", "worker"], "left").join(done.select("episode_id").distinct().withColumn("was", F.lit(True)), "episode_id", "left")
    valid = F.coalesce(F.col("leased_until") > F.col("at"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("episode_id", valid).orderBy("at", "worker"))
    outcome = F.when(F.col("was"), "repeat").when(~valid, "no_lease").when(place == 1, "completed").otherwise("repeat")
    return rows.where(F.col("at") <= now).select("episode_id", "worker", "at", outcome.alias("outcome"))


def threshold_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion, precision, recall, F1 and false-merge rate of (score, truth) at each threshold, in one pass."""
    per = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    rows = pairs.select("score", "truth", per).withColumn("said", F.col("score") >= F.col("threshold"))
    c = rows.groupBy("threshold").agg(*[F.count_if((F.col("said") == s) & (F.col("truth") == t)).alias(n) for n, s, t in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("threshold", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("false_merge_rate"))


def schema_drift(records: DataFrame, mapped: list[str], acl: list[str], ignored: list[str] = ()) -> DataFrame:
    """Per record (id, keys): fields unknown to the schema, expected ones that lack (access fields among them), and
    whether an access field lacks, which holds the whole record back."""
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    said = lambda c: F.array_join(F.array_sort(c), ",")
    lacks = F.array_except(arr([*mapped, *acl]), "keys")
    return records.select("id", said(F.array_except("keys", arr([*mapped, *acl, *ignored]))).alias("unknown"), said(F.array_distinct(lacks)).alias("missing"), (F.size(F.array_except(arr(acl), "keys")) > 0).alias("quarantine"))


def turns(messages: DataFrame) -> DataFrame:
    """Runs of one speaker: conversation, run number, role, how many messages, first turn, characters."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("new", F.coalesce((~F.col("role").eqNullSafe(F.lag("role").over(order))).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(order))
    return rows.groupBy("conv_id", "run", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"))


def latency(samples: DataFrame, step: float = 0.1) -> DataFrame:
    """operation, n, p50, p95, p99 of samples (operation, ms): the smallest time that so many of them do not exceed.

    Times count in steps of ``step`` ms, so an operation has a bounded number of
    different ones, which are counted before anything is sorted.
    """
    times = samples.where("ms IS NOT NULL").groupBy("operation", (F.round(F.col("ms") / step) * step).alias("ms")).agg(F.count("*").alias("c"))
    own = Window.partitionBy("operation")
    ranked = times.withColumn("n", F.sum("c").over(own)).withColumn("upto", F.sum("c").over(own.orderBy("ms")))
    at = lambda p: F.round(F.min(F.when(F.col("upto") >= p / 100 * F.col("n"), F.col("ms"))), 6).alias(f"p{p}")
    return ranked.groupBy("operation").agg(F.max("n").alias("n"), at(50), at(95), at(99))


def gauges(quarantine: DataFrame, runs: DataFrame) -> DataFrame:
    """Open quarantine entries and degraded runs."""
    one = quarantine.where("resolved_at IS NULL").agg(F.count("*").alias("n")).select(F.lit("quarantine_depth").alias("gauge"), "n")
    return one.unionByName(runs.where("state = 'degraded'").agg(F.count("*").alias("n")).select(F.lit("degraded_runs").alias("gauge"), "n"))
